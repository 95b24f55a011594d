import random

from palisade.llm import quality
from tests.llm.helpers import ODD, WORD, documents, rows_of


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dups = set(), 0
    for line in lines:
        dups += line in seen
        seen.add(line)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    inside = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)} if len(windows) < 3000 else None
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, None if inside is None else len(inside)


def test_measures_against_plain_loops(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    rng = random.Random(2)
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += [None, "", " \n ", "a\n\na\na", "é日本\U0001f600 x　y z \x0b\x0c\x1c q", "a b c a b c a b c"]
    for text in texts:
        want = brute_measures(text)
        if want[4] is not None:
            assert tuple(quality.measure(text)) == want


def test_lines_above_the_limits(spark):
    menu = "Home  About   CONTACT"
    body = lambda k: "\n".join(f"line {k} {j} " + " ".join(f"w{k}x{j}x{i}" for i in range(12)) for j in range(6))
    rows = [(k, f"{menu}\n{body(k)}", "a") for k in range(40)]
    rows += [(100 + k, "\n".join(["home about contact"] * 30), "a") for k in range(5)]   # nothing else: depleted
    rows += [(200, f"{menu}\n{body(200)}", "b"), (300, f"{menu}\n{body(300)}", None)]      # other hosts
    docs = documents(spark, rows, "host line removed kept")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert all(got[k].kept and got[k].removed_words == 3 for k in range(40))
    assert not any(got[100 + k].kept for k in range(5))
    assert got[200].removed_words == got[300].removed_words == 0
    cleaned = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert sorted(cleaned) == [*range(40), 200, 300]
    assert cleaned[3].text == body(3) and cleaned[3].n_chars == len(body(3))
    assert cleaned[200].text.startswith(menu)
    assert quality.clean(docs).columns == docs.columns


def test_a_document_counts_once_however_often_it_is_repeated(spark):
    text = "menu line\n" + " ".join(f"w{k}" for k in range(80))
    got = quality.quality(documents(spark, [(1, text)] * 30)).collect()
    assert len(got) == 30 and all(r.kept and r.removed_words == 0 for r in got)


def test_odd_rows(spark):
    docs = documents(spark, ODD, "host n_words words")
    got = rows_of(quality.quality(docs), "doc_id", "n_words", "base_failed", "kept")
    assert len(got) == len(ODD)
    assert (1, 0, True, False) in got and (2, 0, True, False) in got and (4, 30000, True, False) in got
    assert quality.quality(docs.where("false")).count() == 0
    assert quality.clean(docs.where("false")).count() == 0


def test_columns_that_bear_names_of_the_operator(spark):
    menu = "Menu of  the SITE"
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    names = "gone removed row _row host line lines words salt kept c0 c1 c5 n_words removed_words docs n_docs x"
    docs = documents(spark, [(k, f"{menu}\n{body(k)}", "a") for k in range(40)] + [(50, None), (51, "short")], names)
    cleaned = quality.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.dtypes == docs.dtypes
    assert sorted((r.doc_id, r.text, r.gone, r.salt) for r in cleaned.collect()) == [(k, body(k), "x", "x") for k in range(40)]
    assert quality.quality(docs).count() == 42


def test_the_line_rule_changes_verdicts_of_a_whole_table(spark):
    """The query's columns, where documents pass the base rules and are rejected for their lines."""
    common = "\n".join(" ".join(f"t{k}u{j}" for j in range(15)) for k in range(8))
    rows = [(k, common + "\n" + " ".join(f"w{k}x{j}" for j in range(30 if k % 2 else 400)), "h") for k in range(60)]
    got = {r.doc_id: r for r in quality.quality(documents(spark, rows)).collect()}
    assert all(not got[k].base_failed and got[k].removed_words == 8 * 15 and got[k].kept == (k % 2 == 0) for k in range(60))
