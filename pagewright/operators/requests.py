"""Request payloads for a chat-completion model, built as JSON columns.

One payload per batch: a system message, a user message whose first part is
the instruction text, then one part per page (an ``image_url`` data URL for
image pages, a ``text`` part for text pages), at most ten pages.  Built with
``to_json(struct(...))``; null fields are left out of the JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.textfn import data_url

# The reference's prompt texts (indentation removed, one line
# per sentence) and request settings.
DOC_DESCRIPTION = "Be as precise as possible when extracting the information from the images."
FIELDS_SYSTEM = "\n".join([
    "You are an expert in field extraction and image analysis.",
    "Your task is to analyze images and retrieve values for keys in a JSON object, using a provided JSON schema.",
    "If an image contains a graphic, diagram, or chart, you should cease analysis of that image.",
    "Please note that explanations of your output or reasoning are not required.",
    "Do not infer any data based on previous training, strictly use only source text given below as input.",
    "",
    "Your JSON output should:",
    "- be a JSON object that aligns with the provided schema.",
    "- remove all values for the keys not found in the image.",
    "- always include all keys, even if the value is not found.",
    "",
    "These images are originally from a document. Here are instructions related to the document:",
])
FIELDS_USER = "Fill out the fields using the provided JSON schema: "
MARKDOWN_SYSTEM = "\n".join([
    "You are an expert at converting images to markdown.",
    "Return the markdown text output from a single page originally from a scanned PDF.",
    "Using formatting to match the structure of the page as close as you can get.",
    "Only output the markdown and nothing else. Do not explain the output, just return it.",
    "Do not use a single # for a heading. All headings will start with ## or ###.",
    "Skip over images and charts.",
    "Return all text you see in markdown format.",
    "Mark the page number at the top of the markdown's content for each corresponding image.",
    "Do not explain your output or reasoning.",
])
MARKDOWN_USER = "\n".join([
    "In great detail, convert markdown text output from these images.",
    "These images are from pages from a scanned PDF.",
])
SINGLE_CALL_SYSTEM = "\n".join([
    "You are a field extraction expert. When given a series of images, extract all the fields into a JSON object structure.",
    "Treat the series of documents as one cohesive document and return a json mapping all the appropriate fields.",
    "Structure the JSON Object to be respective of each page, and sections.",
    "In the JSON Object, supply information about the page using the Header.",
    "You should return JSON object as your output.",
    "Do not explain your output or reasoning.",
])
SINGLE_CALL_USER = "Return the fields in this document as a complete json object"
MAX_PAGES_PER_REQUEST = 10
MAX_TOKENS = 4096
TEMPERATURE = 0
TOP_P = 0

_PART = "struct<type:string,text:string,image_url:struct<url:string>>"


def _text_part(text: Column) -> Column:
    return F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")
    )


def build_request(batches: DataFrame, system: str, user: Column | str, pages_col: str = "pages",
                  kind: str = "image", max_pages: int = MAX_PAGES_PER_REQUEST,
                  max_tokens: int | None = MAX_TOKENS, out: str = "payload") -> DataFrame:
    """Adds ``out``: the JSON request for each batch.

    ``pages_col`` is ``array<struct<page_no, payload>>`` in page order (see
    ``paging.collect_batches``); ``payload`` is BINARY for ``kind="image"``
    (sent as a JPEG data URL) or STRING for ``kind="text"``.  A batch
    of more than ``max_pages`` pages is an error: cut it with
    ``paging.cap_pages``, which counts what it drops, or batch smaller.
    """
    user_text = F.lit(user) if isinstance(user, str) else user
    if kind == "image":
        def page_part(p):
            return F.struct(
                F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                F.struct(data_url(p["payload"]).alias("url")).alias("image_url"),
            )
    else:
        def page_part(p):
            return _text_part(p["payload"])
    parts = F.concat(F.array(_text_part(user_text)), F.transform(F.col(pages_col), page_part))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.array(_text_part(F.lit(system))).alias("content")),
        F.struct(F.lit("user").alias("role"), parts.alias("content")),
    )
    fields = [messages.alias("messages"), F.lit(TEMPERATURE).alias("temperature"), F.lit(TOP_P).alias("top_p")]
    if max_tokens is not None:
        fields.append(F.lit(max_tokens).alias("max_tokens"))
    size = F.size(pages_col)
    too_many = F.raise_error(F.concat(F.lit("a batch holds "), size.cast("string"), F.lit(f" pages; a request takes {max_pages}")))
    return batches.withColumn(out, F.when(size > max_pages, too_many.cast("string")).otherwise(F.to_json(F.struct(*fields))))


def fields_prompt(template_json: str, description: str = DOC_DESCRIPTION) -> tuple[str, str]:
    """(system, user) texts of a template-filling request."""
    return FIELDS_SYSTEM + "\n" + description, FIELDS_USER + template_json


# The reference's wording where the request holds markdown, and
# where no template is given (indentation removed, one line per sentence).
_IMAGES, _MARKDOWN = "analyze images", "analyze the following markdown text"
NO_TEMPLATE = "\n".join([
    "Given a multi-page markdown file, generate a JSON schema that represents the structure and content of the markdown file.",
    "The resulting JSON Object should include all important fields such as headers, subheaders, lists, links, and text blocks.",
    "The importance of markdown elements should be determined based on their semantic significance in the document structure; "
    "For instance, headers and subheaders might be considered more important than regular text, "
    "and lists might be considered more important than individual list items.",
    "Structure the JSON Object to be respective of each page, and sections.",
])


def text_fields_prompt(template_json: str | None = None, description: str = DOC_DESCRIPTION) -> str:
    """System text of a request over markdown; without a template the model chooses the fields."""
    system = FIELDS_SYSTEM.replace(_IMAGES, _MARKDOWN) + "\n" + description
    return system + "\n" + NO_TEMPLATE if template_json is None else system + " " + FIELDS_USER + template_json


def build_text_request(df: DataFrame, system: str, text_col: str, out: str = "payload") -> DataFrame:
    """Adds ``out``: the JSON-mode request whose user message is the row's text (no token cap)."""
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col(text_col).alias("content")),
    )
    fields = [messages.alias("messages"), F.lit(TEMPERATURE).alias("temperature"),
              F.struct(F.lit("json_object").alias("type")).alias("response_format")]
    return df.withColumn(out, F.to_json(F.struct(*fields)))
