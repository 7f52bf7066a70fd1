"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from clientscope.llm import chat, decontaminate, licenses, line_dedup, line_quality, mixing, near_dup, periodic, pii, secrets, urls

LONG = " ".join(f"word{i % 97} stays{i}" for i in range(40_000)) + "."
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta.\nA line that is found in three documents.", "b"),
    (1, "Alpha beta gamma delta epsilon zeta.\nA line that is found in three documents.", "b"),
    (2, "a line that is found in THREE documents.  \nOther.", "a"),
    (3, "\tA line that is found in three documents.", None),
    (None, "A line that is found in three documents.", "a"),
    (4, "", "a"),
    (5, None, "c"),
    (6, " \n \n", None),
    (7, LONG, "a"),
    (None, None, None),
]
SCHEMA = "doc_id long, text string, source string"
# Columns that share a name with one that the operators make or use inside.
CLASHES = (
    "n_words", "kept", "component_id", "node", "set_key", "size", "target", "rate", "copies", "hash", "slice", "lines", "text_key", "found",
    "rules", "trigram", "host", "path", "verdict", "clean_text", "kept_text", "kept_runs", "hit_words", "matches", "of_doc", "slot0", "nth",
)


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint"))
    return df.withColumns({c: F.lit("x") for c in CLASHES})


def items(spark, rows=((1, "word3 stays3 word4 stays4"), (2, None), (None, ""), (3, "gamma delta"), (3, "gamma delta"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


REPORTS = {
    "quality": lambda s, d: line_quality.judge_lines(d),
    "mix": lambda s, d: mixing.mix_report(d),
    "near": lambda s, d: near_dup.near_groups(d),
    "contamination": lambda s, d: decontaminate.find_contamination(d, items(s)),
    "secrets": lambda s, d: secrets.scan(d),
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "pii": lambda s, d: pii.replace_entities(d, "k"),
    "periodic": lambda s, d: periodic.find_runs(d),
    "urls": lambda s, d: urls.judge_urls(d, d, id_col="doc_id", url_col="text", listed_col="text"),
}
FILTERS = {
    "quality": lambda s, d: line_quality.clean(d, chars_col="n_chars"),
    "lines": lambda s, d: line_dedup.drop_lines(d, chars_col="n_chars"),
    "near": lambda s, d: near_dup.drop_near_copies(d),
    "contamination": lambda s, d: decontaminate.remove_contaminated(d, items(s)),
    "mix": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_keep_every_row(spark, name):
    made = REPORTS[name](spark, docs(spark)).collect()
    ids = sorted((r[0] if r[0] is not None else -1) for r in made)
    assert ids == sorted((r[0] if r[0] is not None else -1) for r in ROWS)


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_keep_the_columns(spark, name):
    before = docs(spark)
    after = FILTERS[name](spark, before)
    assert after.dtypes == before.dtypes
    assert {r.doc_id for r in after.collect()} <= {r[0] for r in ROWS}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_of_nothing(spark, name):
    assert REPORTS[name](spark, docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_of_nothing(spark, name):
    assert FILTERS[name](spark, docs(spark, [])).collect() == []


def test_quality_of_empty_texts(spark):
    made = {r.doc_id: r for r in line_quality.judge_lines(docs(spark)).collect()}
    assert made[4].n_words == made[5].n_words == 0 and made[5].base_failed and not made[5].kept
    assert made[7].n_words == 80_000 and made[7].kept


def test_lines_stay_in_the_largest_id(spark):
    left = {(r.doc_id, r.text) for r in line_dedup.drop_lines(docs(spark)).collect()}
    assert (1, "Alpha beta gamma delta epsilon zeta.") in left and (2, "Other.") in left
    assert (3, "\tA line that is found in three documents.") in left and (None, "") in left and (5, None) in left


def test_line_bitmaps_are_runs(spark):
    runs = {r.doc_id: [tuple(x) for x in r.kept_runs] for r in line_dedup.keep_bitmaps(docs(spark)).collect()}
    assert runs == {1: [(0, 1)], 2: [(1, 1)], None: []}


def test_near_groups_of_null_ids(spark):
    made = near_dup.near_groups(docs(spark), near_dup.Near(words=4)).collect()
    by = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in made}
    assert by[2, 6] == (2, True) and by[3, 5] == by[None, 5] == (2, False) and by[4, 0] == (4, True) and by[None, 0] == (None, True)


def test_near_copies_go_by_row(spark):
    """Rows without an id stay unless they are copies themselves; so do other texts of an id."""
    copy, other = "one two three four five six seven", "quite another text that is like nothing else"
    rows = [(1, copy, "a"), (None, copy, "b"), (None, other, "c"), (None, "", "d"), (None, None, "e"), (2, copy, "f"), (2, "a second text of one id", "g")]
    left = near_dup.drop_near_copies(docs(spark, rows)).collect()
    assert sorted(r.source for r in left) == ["a", "c", "d", "e", "g"]


def test_near_filter_agrees_with_the_report(spark):
    kept = near_dup.near_groups(docs(spark)).where("kept").collect()
    left = near_dup.drop_near_copies(docs(spark)).collect()
    assert sorted(map(str, (r.doc_id for r in left))) == sorted(map(str, (r.doc_id for r in kept)))


def test_contamination_of_short_items(spark):
    made = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in decontaminate.find_contamination(docs(spark), items(spark)).collect()}
    assert made[1, 14] == (2, 1) and made[5, 0] == (0, 0) and made[2, 9] == (0, 0)


def test_blocks_of_items_change_nothing(spark):
    """Three words a block or a million, items over several files or one: all columns agree; a repeated id matches once."""
    rows = [(k, f"word{k % 97} stays{k} word{(k + 1) % 97} stays{k + 1} word{(k + 2) % 97}") for k in range(40)] + [(3, "word3 stays3 word4"), (7, "beta gamma")]
    bench = items(spark, rows)
    whole = decontaminate.find_contamination(docs(spark), bench.coalesce(1)).collect()
    for cut in (bench.repartition(5), bench.coalesce(1)):
        made = decontaminate.find_contamination(docs(spark), cut, block_words=3).collect()
        assert sorted(map(str, made)) == sorted(map(str, whole))
    long = next(r for r in whole if r.doc_id == 7)
    assert long.n_items == 40 and len({m.item_id for m in long.matches}) == len(long.matches) == 40


def test_no_items_and_no_rules(spark):
    none = decontaminate.find_contamination(docs(spark), items(spark, []))
    assert none.where("contaminated").count() == 0 and none.count() == len(ROWS)
    assert secrets.scan(docs(spark), []).where("size(found) > 0").count() == 0
    listed = docs(spark, [])
    assert urls.judge_urls(docs(spark), listed, id_col="doc_id", url_col="text", listed_col="text").where("verdict = 'block'").count() == 0


def test_sources_without_words(spark):
    made = {(r.doc_id, r.size): r for r in mixing.mix_report(docs(spark)).collect()}
    assert made[5, 0].target == 0 and made[5, 0].taken == 0 and made[4, 0].taken == 0


def test_chats_with_nulls_and_ties(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (2, None, None, "x"), (None, 0, "user", "a"), (None, 0, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    made = chat.format_chats(frame).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.valid) for r in made) == [(0, 1, False), (0, 1, False), (1, 3, False), (2, 1, False)]
    one = next(r for r in made if r.conv_id == 1)
    assert one.bad_turn == 1 and one.formatted == "<s>[INST] q [/INST][INST] q [/INST] </s>"
    assert chat.format_chats(frame.limit(0)).collect() == []


def test_very_long_chats_and_lines(spark):
    """A turn of a million characters comes back whole; of 20,000 lines those that repeat in three texts go."""
    text = "</s>[INST] " + "word " * 200_000
    frame = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(frame).select(chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).first()
    assert [t.text for t in made.turns] == [text, text] and made.loss == text
    lines = [f"line number {k} that is found in several texts" for k in range(20_000)]
    rows = [(1, "\n".join(lines), "a"), (2, "\n".join(lines[:100]), "a"), (3, "\n".join(lines[50:150]), "a")]
    left = {r.doc_id: r.text.split("\n") for r in line_dedup.drop_lines(docs(spark, rows)).collect()}
    assert left[1] == lines[:50] + lines[100:] and left[2] == lines[:50] and left[3] == lines[50:150]
