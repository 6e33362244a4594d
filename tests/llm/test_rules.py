"""Quality rules, sharding and toxicity."""

from __future__ import annotations

import pytest
from compare import check

from digestmill.llm.quality_rules import host_verdicts, keep_good, measures, prior, quality_rules
from digestmill.llm.queries import ORACLES, QUERIES
from digestmill.llm.sharding import lookup_table, place
from digestmill.llm.toxicity import ToxicityModel, folded_words, hits, learn_toxicity, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(shared, name):
    ok, message = check(shared, name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


def test_repeated_windows(shared):
    texts = ["a b c a b c", "a b c d", "a a a a", "x\ny\nx\n \n\n", "", None, "a b", "# $ & word"]
    frame = shared.createDataFrame([(at, text, "h") for at, text in enumerate(texts)], "doc_id long, text string, source string")
    rows = {row.doc_id: row for row in measures(frame).collect()}
    assert [rows[at].n_repeat_words for at in range(8)] == [6, 0, 4, 0, 0, 0, 0, 0]
    assert [rows[at].n_dup_lines for at in (3, 4, 5)] == [1, 0, 0] and rows[7].n_symbols == 3 and rows[5].n_words == 0 and rows[0].word_chars == 6


def test_hosts(shared):
    good = " ".join(f"w{at}" for at in range(60))
    rows = [(at, good if at % 10 else "short", "good") for at in range(400)] + [(1000 + at, "short" if at % 10 else good, "bad") for at in range(400)]
    rows += [(2000, "short", "tiny"), (2001, good, None)] + [(3000 + at, good, f"host{at % 20}") for at in range(200)]
    frame = shared.createDataFrame(rows, "doc_id long, text string, source string")
    verdicts = {row.host: row for row in host_verdicts(measures(frame)).collect()}
    assert verdicts["bad"].host_failed and not verdicts["good"].host_failed and None not in verdicts
    # One document tells little: the shrunk rate stays near the corpus rate.
    assert verdicts["tiny"].rate_short < 1
    kept = {row.doc_id: row.kept for row in quality_rules(frame).collect()}
    assert not any(kept[1000 + at] for at in range(400)) and kept[1] and not kept[0] and kept[2001] and len(kept) == len(rows)
    assert keep_good(frame).count() == sum(kept.values())


def test_prior():
    assert prior(0, 0, None, None) == (0.0, 1.0)
    alpha, strength = prior(2, 200, 20, 2.0)  # both hosts at the mean: as strong as it gets
    assert strength == 1e6 and abs(alpha - 1e5) < 1e-6
    assert prior(2, 200, 100, 100.0)[1] == 1.0  # all or nothing by host: as weak as it gets


def test_odd_rows(odd, shared):
    rows = quality_rules(odd).collect()
    assert len(rows) == odd.count() and all(row.base_failed for row in rows if row.doc_id != 4)
    assert quality_rules(odd.limit(0)).count() == 0 and keep_good(odd).columns == odd.columns
    assert place(odd, ["a", "b"], 7).count() == odd.count() and place(odd.limit(0), ["a"], 2).count() == 0


def test_table_shares_and_moves():
    shards = [f"s{at}" for at in range(10)]
    table = lookup_table(shards, 1021)
    counts = [table.count(shard) for shard in shards]
    assert max(counts) - min(counts) <= 1
    fewer = lookup_table(shards[:-1], 1021)
    moved = sum(one != other for one, other in zip(table, fewer, strict=True) if one != "s9")
    assert moved < 0.15 * 1021
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError, match="different names"):
            lookup_table(bad, 7)
    with pytest.raises(ValueError, match="prime"):
        lookup_table(["a"], 8)


def test_folding_and_exceptions():
    assert folded_words("1D10T ıdіоt Ｉｄｉｏｔ id​iot") == ["idiot"] * 4
    model = ToxicityModel({"idiot": 2.0}, ("dear idiot",), 1.0, -1.0)
    assert [word for word, _ in hits(model.automaton(), folded_words("you idiot, dear 1d1ot idiotic idiot"))] == ["idiot", "idiot"]
    assert hits(ToxicityModel({}, (), 0, 0).automaton(), ["a"]) == []


def test_learning_and_held_out(shared):
    rows = [(at, f"the quiet word{at % 7} of day {at} " * 3 + ("sc0undrel nasty " if at % 5 == 0 else "") + f"more text{at % 11}", int(at % 5 == 0)) for at in range(600)]
    docs = shared.createDataFrame([(at, text) for at, text, _ in rows], "doc_id long, text string")
    labels = shared.createDataFrame([(at, label) for at, _, label in rows if at < 400] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = learn_toxicity(docs, labels)
    assert set(model.weights) == {"scoundrei", "nasty"}
    scores = {row.doc_id: row.score for row in toxicity(docs, model).collect()}
    assert all((scores[at] >= 0.3) == bool(label) for at, _, label in rows if at >= 400)
    assert learn_toxicity(docs, labels.filter("toxic = 0")).weights == {}


def test_toxicity_of_odd_rows(odd):
    rows = toxicity(odd, ToxicityModel({"same": 1.0}, (), 1.0, -1.0)).collect()
    assert len(rows) == odd.count() and all(0 <= row.score <= 1 for row in rows) and sum(row.n_hits for row in rows) == 4
    assert toxicity(odd.limit(0), ToxicityModel({}, (), 0.0, 0.0)).count() == 0


def test_toxicity_query_on_held_out_rows(shared):
    rows = QUERIES["op1_toxicity"](shared, "/root/testdata/sf0.01").join(shared.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    held = rows.filter("held_out").collect()
    right = sum(row.predicted == row.toxic for row in held)
    assert right >= 0.85 * len(held)
