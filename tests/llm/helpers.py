"""Small tables and plain loops for the corpus tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, rows, extra=""):
    """A documents table from (doc_id, text[, source]) rows."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    frame = spark.createDataFrame(full, DOCS)
    for name in extra.split():
        frame = frame.selectExpr("*", f"'x' AS {name}")
    return frame


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def groups(links, nodes):
    """Smallest member of each node's component, by repeated passes."""
    name = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return name


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word " * 30000), (5, "x" * 200000), (6, "same text here"), (6, "same text here"),
       (None, "no id at all"), (7, "é日本\U0001f600 #*$%&|<> \x00 \x0b")]
