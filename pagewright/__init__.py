"""pagewright: document-extraction data work expressed as Spark DataFrame jobs.

Documents are cut into pages, pages are ordered and batched, batch replies are
cleaned and parsed, batches are combined into one record per document, pages are
stitched to markdown, and token / cost / time metrics are aggregated.  Every
public function takes and returns DataFrames (or Columns); none collects data
to the driver.
"""

__version__ = "0.1.0"
