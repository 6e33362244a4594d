"""Library rows, search, listing, favourites and paths on literal rows; scale helpers against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from digestmill.functions import scale
from digestmill.operators import library as L
from digestmill.plans.bindings import view

SF = "/root/testdata/sf0.001"


def library(spark, *files):
    rows = [(path, content, float(i), len(content)) for i, (path, content) in enumerate(files)]
    return L.library_rows(spark.createDataFrame(rows, "relative_path STRING, content STRING, mtime DOUBLE, size BIGINT"))


def found(spark, rows, query, **options):
    return [row["relative_path"] for row in L.search(rows, L.build_postings(rows), query, **options).collect()]


def test_chinese_phrase_search(spark):
    rows = library(spark, ("2026-07-14/web/example.md", "# 缓存正确性\n\n缓存键包含模型切换和强制刷新。"), ("2026-07-14/web/other.md", "# 切换模型"))
    row = L.search(rows, L.build_postings(rows), "模型切换").collect()[0]
    assert (row["title"], row["source_type"]) == ("缓存正确性", "web") and "模型切换" in row["snippet"]
    assert found(spark, rows, "模型切换") == ["2026-07-14/web/example.md"]
    assert found(spark, rows.filter("relative_path LIKE '%other%'"), "模型切换") == []


def test_search_rules(spark):
    rows = library(spark, ("d/web/a.md", "Alpha beta_gamma delta"), ("d/web/b.md", "beta gamma"), ("d/wx/c.md", "gamma beta alpha"))
    assert found(spark, rows, "beta_gamma") == ["d/web/b.md", "d/web/a.md"]
    assert found(spark, rows, "ALPHA, gamma") == ["d/wx/c.md", "d/web/a.md"]
    assert found(spark, rows, "alpha", source_type="web") == ["d/web/a.md"]
    assert found(spark, rows, "gamma", limit=1) == ["d/wx/c.md"]
    assert found(spark, rows, "  ") == [] and found(spark, rows, "!!") == [] and found(spark, rows, "___") == []
    # A phrase may cross from the title into the path and on into the content.
    assert found(spark, rows, "md_alpha") == ["d/web/a.md"]


def test_repeated_terms_in_a_phrase(spark):
    rows = library(spark, ("d/w/a.md", "go go home"), ("d/w/b.md", "go home go"))
    assert found(spark, rows, "go_go_home") == ["d/w/a.md"]


def test_search_equals_brute_force(spark):
    random.seed(3)
    texts = {f"d/w/{i}.md": " ".join(random.choice(["a1", "b2", "c3", "字"]) for _ in range(12)) for i in range(30)}
    rows = library(spark, *texts.items())
    stored = {r["relative_path"]: L.re.findall(r"[一-鿿]|[a-z0-9]+", r["search_text"]) for r in rows.collect()}

    def has(tokens, phrase):
        return any(tokens[i : i + len(phrase)] == phrase for i in range(len(tokens)))

    for query in ("a1_b2", "字字", "a1 b2_c3 字", "c3_c3_c3"):
        expected = {path for path, tokens in stored.items() if all(has(tokens, clause) for clause in L.query_clauses(query))}
        assert set(found(spark, rows, query, limit=100)) == expected, query


def test_hidden_files(spark):
    paths = ["d/w/x.md", "d/w/x/summary.md", "d/w/x/timeline.md", "d/w/latest.md", "favorites/d/w/x.md", "d/w/x.txt"]
    assert [row["relative_path"] for row in library(spark, *[(p, "t") for p in paths]).collect()] == ["d/w/x.md"]


def test_listing_totals(spark):
    files = spark.createDataFrame([(f"d/w/12345{i}-note-{i}.md", "t", float(i), 1) for i in range(5)], "relative_path STRING, content STRING, mtime DOUBLE, size BIGINT")
    favorites = spark.createDataFrame([("d/w/123454-note-4.md",)], "relative_path STRING")
    rows = L.list_library(files, favorites, 2).collect()
    assert [(r["title"], r["is_favorite"], r["total_candidates"], r["limited"]) for r in rows] == [("note 4", True, 5, True), ("note 3", False, 5, True)]


def test_favourites_are_idempotent(spark):
    lib = spark.createDataFrame([("d/w/a.md",), ("d/w/b.md",)], "relative_path STRING")
    picks = spark.createDataFrame([(1, "d/w/a.md"), (2, "/d/w/a.md"), (3, "../d/w/b.md"), (4, "d/w/none.md")], "pick_id INT, raw_path STRING")
    none = spark.createDataFrame([], "relative_path STRING, favorited_at STRING")
    outcome = {r["pick_id"]: r["outcome"] for r in L.pick_results(lib, none, picks).collect()}
    assert outcome == {1: "added", 2: "already_favorited", 3: "not_found", 4: "not_found"}
    once = L.add_favorites(lib, none, picks, F.lit("t"))
    assert once.count() == 1 and L.add_favorites(lib, once, picks, F.lit("u")).collect() == once.collect()
    assert L.remove_favorites(once, picks).count() == 0


def test_anchors_are_unique_even_against_numbered_titles(spark):
    frame = spark.createDataFrame([("p", "# a\n## a\ntext\n# a-2\n##### deep\n#no\n# !!\n# a")], "relative_path STRING, content STRING")
    rows = L.toc(frame).orderBy("seq").collect()
    assert [(r["level"], r["anchor"]) for r in rows] == [(1, "a"), (2, "a-2"), (1, "a-2-2"), (1, "section"), (1, "a-3")]
    many = spark.createDataFrame([("p", "\n".join(["# same"] * 40))], "relative_path STRING, content STRING")
    anchors = ["same"] + [f"same-{i}" for i in range(2, 41)]
    assert [r["anchor"] for r in L.toc(many).orderBy("seq").collect()] == anchors
    assert [r["anchor"] for r in L.toc(many, 24).orderBy("seq").collect()] == anchors[:24]


def test_connector_directory_is_a_slug(spark):
    rows = spark.createDataFrame([(i, "  Same / Title!", "feishu_document", "2026-07-14 08:09:10") for i in (5, 3, 9)], "doc_id BIGINT, title STRING, source_type STRING, t STRING")
    paths = {r["doc_id"]: r["relative_path"] for r in L.output_paths(rows.withColumn("written_at", F.col("t").cast("timestamp"))).collect()}
    base = "2026-07-14/feishu-document/080910-same-title"
    assert paths == {3: base + ".md", 5: base + "-2.md", 9: base + "-3.md"}


@pytest.mark.parametrize("kind", ["BIGINT", "STRING"])
def test_numbered_within_equals_row_number(spark, kind):
    random.seed(4)
    # One key holds most of the rows, one is NULL, and ids are far apart.
    rows = [(i * 10**12, "hot" if random.random() < 0.7 else None if i % 7 == 0 else f"k{i % 5}") for i in range(300)]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "id BIGINT, key STRING").withColumn("id", F.col("id").cast(kind))
    expected = frame.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id")).cast("bigint"))
    found_rows = scale.numbered_within(frame, ["key"], "id", "n")
    assert sorted(map(str, found_rows.select("id", "key", "n").collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_in_order_equals_lag(spark, chunk):
    random.seed(11)
    rows = []
    for key in range(40):
        values = sorted(random.randint(0, 30) for _ in range(20))
        if key % 3 == 0:
            place = random.randint(1, 19)
            values[place] = values[place - 1] - 1
        rows += [(key, i, None if random.random() < 0.1 else float(v)) for i, v in enumerate(values)]
    expected = {}
    for key, _, value in rows:
        if value is not None:
            ok, last = expected.get(key, (True, value))
            expected[key] = (ok and value >= last, value)
    frame = spark.createDataFrame(rows, "key INT, i INT, v DOUBLE").repartition(5)
    got = {r["key"]: r["ok"] for r in scale.in_order(frame, "key", "i", F.col("v"), "ok", chunk_rows=chunk).collect()}
    assert got == {key: ok for key, (ok, _) in expected.items()}


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    from compare import rows_of

    from digestmill.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    names = ["fold_jobs", "validate_timing", "output_paths", "search_phrase", "cues_from_vtt"]

    def run():
        frames = [QUERIES[name](spark, sf) for name in names]
        return [rows_of(frame.columns, [tuple(row) for row in frame.collect()]) for frame in frames]

    before = run()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert run() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_two_writes_repeat_no_path(spark, tmp_path):
    from digestmill.sources.packages import write_library

    root = str(tmp_path / "library")

    def digests(*ids):
        rows = [(key, "Same title", "web", f"text {key}") for key in ids]
        return spark.createDataFrame(rows, "doc_id STRING, title STRING, source_type STRING, summary_markdown STRING").withColumn("written_at", F.lit("2024-03-01 12:00:00").cast("timestamp"))

    write_library(digests("a", "b"), root)
    write_library(digests("c", "b"), root)
    write_library(digests("c", "b"), root)  # a retry
    paths = {row["doc_id"]: row["relative_path"] for row in spark.read.parquet(root).collect()}
    stem = "2024-03-01/web/120000-same-title"
    assert paths == {"a": f"{stem}.md", "b": f"{stem}-2.md", "c": f"{stem}-3.md"} and spark.read.parquet(root).count() == 3


def test_trigrams_find_what_the_scan_finds(spark, tmp_path, monkeypatch):
    """Stored trigrams: the same rows as without, few and many candidates, needles too short for a gram, wild cards."""
    rows = L.library_rows(view(spark, SF, "v_files"))
    rows = rows.unionByName(rows.limit(1).withColumn("relative_path", F.lit("2024-01-01/x/odd.md")).withColumn("title", F.lit("Odd")).withColumn("search_text", F.lit("snake_case caf\u00e9 \U0001f600 end")).withColumn("content", F.lit("a\nb 100% x\U0001f600y")))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for name, text in (("like", L.like_text()), ("scan", L.scan_text())):
        L.write_trigrams(L.build_trigrams(rows, text), str(tmp_path / name), files=5)
    like, scan = (spark.read.parquet(str(tmp_path / name)) for name in ("like", "scan"))
    for most in (10_000, 0):
        monkeypatch.setattr(L, "MOST_PATHS", most)
        for query in ("the of", "snake_case", "sn_ke", "ab", "zzzqqq", "tion and"):
            found = L.search_like(rows, query, trigrams=like)
            assert [row[0] for row in found.select("relative_path").collect()] == [row[0] for row in L.search_like(rows, query).select("relative_path").collect()], query
        for query in ("inG The", "a\nb", "100% x", "x\U0001f600y", "e", "", "zzzqqq"):
            found = L.search_scan(rows, query, trigrams=scan)
            assert [row[0] for row in found.select("relative_path").collect()] == [row[0] for row in L.search_scan(rows, query).select("relative_path").collect()], query
    plan = scan.filter(F.col("gram").isin(L.needle_grams("odd"))).groupBy("relative_path").count()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "odd" in plan.split("PushedFilters")[1].split("]")[0]
    assert L.needle_grams("ab_cdef_gh", "_") == ["cde", "def"]
    monkeypatch.setattr(L, "MOST_PATHS", 10_000)
    chosen = L.candidates(rows, like, "snake_case")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(relative_path,2024-01-01/x/odd.md)" in chosen or "In(relative_path" in chosen


def test_token_totals_count_documents_once(spark):
    """Paths of their own are counted within their row, so that postings meet by token alone; rows that share a path are one document."""
    rows = [("a.md", "x y x 中 x"), ("b.md", "y"), ("b.md", "y z"), ("c.md", ""), ("b.md", None), ("d.md", "z_z y")]
    got = {tuple(row) for row in L.token_totals(spark.createDataFrame(rows, "relative_path string, search_text string")).collect()}
    assert got == {("x", 3, 1, 6), ("y", 4, 3, 3), ("中", 1, 1, 3), ("z", 3, 2, 2)}
