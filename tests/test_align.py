"""Template filled from labels: invented pages with known answers, precision and recall, ties and odd values."""

import json
import random

from pagewright.operators import align

TEMPLATE = {
    "title": "", "issuedOn": "", "vessel": {"name": "", "length_m": 0, "home_port": ""},
    "cargo": {"weight": 0, "gross": {"weight": 0}, "insured": True}, "crew_members": [""], "tide_levels": [0],
}


def fill(spark, pages, template=TEMPLATE):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, md string")
    rows = align.fill_from_labels(df, "md", template, ["id"]).orderBy("id").collect()
    assert "Exchange" not in align.fill_from_labels(df, "md", template, ["id"])._jdf.queryExecution().executedPlan().toString()
    return [json.loads(r.j) for r in rows], [[tuple(m) for m in r.matches] for r in rows]


EMPTY = {"title": "", "issuedOn": "", "vessel": {"name": "", "length_m": "", "home_port": ""},
         "cargo": {"weight": "", "gross": {"weight": ""}, "insured": ""}, "crew_members": [], "tide_levels": []}


def test_a_page_is_filled_from_the_template_alone(spark):
    page = ("Page 1\n\n## Vessel\n- **Name:** Grey Heron\nLength (m): 1,204.50 m\nPort, home: Skarn\nIssued on: 3 May\n"
            "## Cargo\nGross weight: 0040 t\nWeight: 12\n| Insured | yes |\nCrew members: Ada; Bo, Cy\nTide level: 1.5, 2 and -3\nat 10:30 sharp\nFax: 99")
    (got,), (matches,) = fill(spark, [page])
    assert got == {"title": "", "issuedOn": "3 May", "vessel": {"name": "Grey Heron", "length_m": 1204.5, "home_port": "Skarn"},
                   "cargo": {"weight": 12, "gross": {"weight": 40}, "insured": True}, "crew_members": ["Ada", "Bo", "Cy"], "tide_levels": [1.5, 2]}
    assert ("vessel.name", 4, 1.0) in matches and len({m[0] for m in matches}) == len(matches) == len({m[1] for m in matches})


def test_empty_and_odd_pages(spark):
    got, matches = fill(spark, ["", None, "no labels here", "## Title\n:\nTitle:\nTitle: \n", "Weight: none\nInsured: maybe\nTitle: \"q\" \\ é"])
    assert got[:4] == [EMPTY] * 4 and matches[:4] == [[]] * 4
    assert got[4] == EMPTY | {"title": '"q" \\ é'}


def test_each_line_and_each_key_once_best_first(spark):
    # Two labels for one key, one label for two keys: the best pair first, then what is left.
    got, _ = fill(spark, ["Nam: a\nName: b", "Name: x", "Weight: 1\nGross weight: 2", "Gros weight: 7"],
                  {"name": "", "names": "", "weight": 0, "gross_weight": 0})
    assert got[0]["name"] == "b" and got[0]["names"] == ""
    assert got[1] == {"name": "x", "names": "", "weight": "", "gross_weight": ""}
    assert (got[2]["weight"], got[2]["gross_weight"]) == (1, 2)
    assert (got[3]["weight"], got[3]["gross_weight"]) == ("", 7)


def test_blocking_loses_nothing_above_the_threshold():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    rng = random.Random(1)
    for _ in range(20_000):
        a = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 14)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = rng.choice(["", "x", "a"])
        b = "".join(b)
        if b and 1 - distance(a, b) / max(len(a), len(b)) >= align.THRESHOLD:
            assert set(align._bigrams(a)) & set(align._bigrams(b))


def test_precision_and_recall_on_invented_pages(spark):
    rng = random.Random(12)
    leaves = align.template_leaves(TEMPLATE)

    def label(keys):
        words = align._name(keys[-1]).split() if len(keys) == 1 or rng.random() < 0.3 else [w for k in keys for w in align._name(k).split()]
        if rng.random() < 0.4:
            rng.shuffle(words)
        text = rng.choice([" ", "-", "_"]).join(rng.choice([w, w.upper(), w.capitalize()]) for w in words)
        if rng.random() < 0.4 and len(text) > 6:  # a typing error
            at = rng.randrange(1, len(text) - 1)
            text = text[:at] + rng.choice(["", "x", text[at] * 2]) + text[at + 1:]
        return text

    noise = ["Fax: 12 34", "Remark: none", "See page: 4", "plain text line", "Signed by: the harbour master", "- item", "## Annex"]
    pages, truth = [], []
    for _ in range(150):
        lines, want = [], {}
        for keys, kind in leaves:
            if rng.random() < 0.75:
                value = str(rng.randrange(10, 99)) if kind in ("number", "numbers") else "yes" if kind == "boolean" else f"v{rng.randrange(99)}"
                lines.append(rng.choice(["", "- "]) + f"{label(keys)}: {value}")
                want[".".join(keys)] = len(lines)
        order = list(range(len(lines)))
        rng.shuffle(order)
        place = {old + 1: new + 1 for new, old in enumerate(order)}
        pages.append("\n".join([lines[i] for i in order] + rng.sample(noise, 4)))
        truth.append({(p, place[n]) for p, n in want.items()})
    _, matches = fill(spark, pages)
    found = [{(p, n) for p, n, _ in m} for m in matches]
    right = sum(len(f & t) for f, t in zip(found, truth))
    precision, recall = right / sum(map(len, found)), right / sum(map(len, truth))
    print(f"precision {precision:.3f} recall {recall:.3f}")
    assert precision > 0.9 and recall > 0.85
