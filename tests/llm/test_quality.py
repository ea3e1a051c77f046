import brute
import pytest
from conftest import SMALL

from corpusloom.llm import quality, queries

NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def expected(docs):
    return sorted(((d, *[brute.features(t)[n] for n in NAMES], brute.kept(t)) for d, t in docs), key=str)


def test_odd_rows(odd, odd_rows, clashing):
    extra = [(200, "a b c a b c a b c", None, None, 0), (201, "x\nx\n\ny\nx", None, None, 0), (202, "a " * 300, None, None, 0)]
    docs = clashing(odd.unionByName(odd.sparkSession.createDataFrame(extra, odd.schema)))
    found = quality.report(docs)
    rows = sorted(((r["doc_id"], *[r[n] for n in NAMES], r["rejected_by"] is None) for r in found.collect()), key=str)
    assert rows == expected([(r[0], r[1]) for r in [*odd_rows, *extra]])


def test_few_and_many_repeated_windows(spark):
    """On both sides of the number of different windows that are looked for one by one."""
    rows = []
    for k, n in enumerate((1, 2, 3, 4, 33, 34, 35, 36, 37, 400)):
        part = " ".join(f"w{i}" for i in range(n))
        rows += [(10 * k, f"{part} x {part}"), (10 * k + 1, f"{part} {part} y {part}"), (10 * k + 2, part), (10 * k + 3, "b a a b " * n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert quality.FEW_WINDOWS in range(31, 36)
    got = docs.select("doc_id", *[quality.features(quality.F.col("text"))[n].alias(n) for n in ("n_repeat_words", "n_top_word")])
    found = {r[0]: (r[1], r[2]) for r in got.collect()}
    assert found == {d: tuple(brute.features(t)[n] for n in ("n_repeat_words", "n_top_word")) for d, t in rows}


def test_order_changes_no_verdict(odd):
    rules = quality.default_rules()
    lazy = quality.features(quality.F.col("text")).__getitem__
    verdicts = [
        sorted(map(str, odd.select("doc_id", quality.rejected_by(order, lazy).isNull().alias("kept")).collect()))
        for order in (rules, rules[::-1], rules[2:] + rules[:2])
    ]
    assert verdicts[0] == verdicts[1] == verdicts[2]


def test_rules_by_rejections_per_work():
    """The second rule is left nothing by the third, so it goes last but for those that reject nothing at all."""
    rules = quality.default_rules()[:4]
    outcomes = [
        quality.Outcome((False, True, True, False), 50, (50.0, 100.0, 50.0, 50.0)),
        quality.Outcome((True, False, False, False), 10, (10.0, 20.0, 10.0, 10.0)),
        quality.Outcome((False, False, False, False), 40, (40.0, 80.0, 40.0, 40.0)),
    ]
    assert [r.name for r in quality.in_order(rules, outcomes)] == ["symbols", "min_words", "repeated_words", "dup_lines"]


def test_same_order_every_time(spark):
    docs, rules = spark.read.parquet(f"{SMALL}/documents.parquet"), quality.default_rules()
    orders = [[r.name for r in quality.in_order(rules, quality.estimate(docs, rules))] for _ in range(3)]
    assert orders[0] == orders[1] == orders[2] and sorted(orders[0]) == sorted(r.name for r in rules)


def test_a_rule_sees_what_earlier_rules_leave(spark, odd, odd_rows):
    """A rule after two others is evaluated for the rows that both leave, and for no other."""
    F = quality.F
    seen = F.reflect(F.lit("java.lang.System"), F.lit("setProperty"), F.concat(F.lit("rule-saw-"), F.col("doc_id")), F.lit("x"))
    noted = quality.Rule("noted", lambda f: seen == "never")
    few, repeated = quality.default_rules()[:2]
    lazy = quality.features(F.col("text")).__getitem__
    odd.where("doc_id IS NOT NULL").select(quality.rejected_by([few, repeated, noted], lazy)).collect()
    names = [str(x) for x in spark._jvm.java.lang.System.getProperties().stringPropertyNames()]
    facts = [(r[0], brute.features(r[1])) for r in odd_rows if r[0] is not None]
    left = {d for d, f in facts if f["n_words"] >= 50 and 2 * f["n_repeat_words"] <= f["n_words"]}
    assert {int(x.removeprefix("rule-saw-")) for x in names if x.startswith("rule-saw-")} == left
    assert 0 < len(left) < len({d for d, _ in facts})


def test_rules_of_lines_and_words(spark):
    """One text for each rule beyond the base features, and one that passes them all."""
    good = " ".join(f"word{k}" for k in range(60))
    texts = {
        "bullets": "\n".join(f"- item number{k} of many words" for k in range(20)),
        "ellipses": "\n".join(f"line number{k} breaks off here{'...' if k % 2 else ' \u2026 '}" for k in range(20)),
        "no_letter": " ".join([f"{k}.5" for k in range(60)] + [f"w{k}" for k in range(40)]),
        "top_word": " ".join(f"the w{k}" for k in range(60)),
        None: good,
    }
    docs = spark.createDataFrame([(t, name) for name, t in texts.items()], "text string, name string")
    rows = docs.select("name", quality.judge(docs).alias("found")).collect()
    assert all(r["name"] == r["found"] for r in rows) and [brute.kept(t) for t in texts.values()] == [False] * 4 + [True]


def test_later_rules_do_not_run(spark):
    """A document leaves the cascade at its first rejection."""
    fails = quality.Rule("fails", lambda f: quality.F.raise_error(quality.F.lit("ran")).cast("boolean"))
    docs = spark.createDataFrame([("a b",)], "text string")
    verdict = quality.rejected_by([quality.default_rules()[0], fails], quality.features(quality.F.col("text")).__getitem__)
    assert docs.select(verdict).first()[0] == "min_words"


def test_rows_stay_as_they_are(odd, odd_rows, clashing):
    docs = clashing(odd)
    left = quality.keep_good(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r[0]) for r in odd_rows if brute.kept(r[1]))


def test_empty(empty):
    assert quality.report(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_clean_documents_stay(spark):
    """Labelled good documents of enough words are kept, but for those that repeat themselves."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").select("doc_id")
    found = queries.op6_quality(spark, SMALL).join(labels, "doc_id").where("not base_failed")
    assert found.count() and found.where("not kept").count() == 0


def test_query(spark, texts):
    rows = [tuple(r) for r in queries.op6_quality(spark, SMALL).collect()]
    made = []
    for d, t, _ in texts:
        f = brute.features(t)
        failed = f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"]
        made.append((d, *[f[n] for n in NAMES if n != "n_lines"], failed, brute.kept(t)))
    assert sorted(rows) == sorted(made)
