"""MinHash near-duplicates by a chosen-path set similarity join, and the classes it links.

1. Documents with equal sets of shingles are one class; one document of a class goes on.
2. Each class has ``POSITIONS`` minwise tokens of its set and a sketch of one bit of each. In each of ``TREES``
   independent trees a node picks, by a hash of its path alone, one or two of the positions, 1 / similarity of them on
   average, and its documents branch by their tokens there. Similar documents stay together on one path at least with
   a chance that hardly falls with the depth; the trees together bring the recall to the target.
3. A node of ``NODE`` documents or fewer is compared exhaustively by sketches. A larger one is compared with a centre
   of its own and branches on, unless all of it is similar to the centre.
4. What the sketches find alike is a cluster. Within it all pairs that no link joins yet are confirmed on the full sets,
   most alike first. A cluster beyond one cell is compared cell by cell with common representatives first; only the
   documents these leave outside the largest component then meet all other cells.

Links are closed to components by contraction.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill.functions.scale import shared_folder
from digestmill.llm.components import connected, stars
from digestmill.llm.rows import slim
from digestmill.llm.shingles import mixed, shingle_set, signature

WORDS = 2
PERCENT = 80
POSITIONS = 128
TREES = 10
# Documents of a node that is compared exhaustively, and levels of a tree at most.
NODE, DEPTH = 64, 12
# Equal bits of two sketches: 115 +- 3.4 are expected at a similarity of 0.8, 64 of unlike texts. Five deviations are allowed.
LEAST_ALIKE = 98
# Tokens and documents of one cell of a cluster, the unit of confirmation, and representatives of a larger cluster.
CELL_TOKENS, CELL_DOCUMENTS, REPRESENTATIVES = 1_000_000, 2_000, 32
# Slim rows of candidates (8 to 48 bytes) and open paths of all levels are broadcast up to this number; more are joined.
MOST_BROADCAST = 1_000_000

_ODD = mixed(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SALTS = mixed(np.arange(POSITIONS + 1, POSITIONS + 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minwise(tokens: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of ``POSITIONS`` hash functions; sets of any size in pieces."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(tokens), 4096):
        np.minimum(least, (tokens[start : start + 4096, None] * _ODD).min(axis=0), out=least)
    return least


def sketch(least: np.ndarray) -> np.ndarray:
    """One bit of each least hash, in two words."""
    return np.packbits((least >> np.uint64(12)).astype(np.uint8) & 1).view(np.uint64)


def set_marks(texts: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles``, a 128-bit hash of the set, its sketch and its minwise tokens, for every row."""
    names = ["doc_id", "n_shingles", "set_a", "set_b", "sketch_a", "sketch_b", "tokens"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words) for text in batch.column(1).to_pylist()]
            least = [minwise(tokens) for tokens in sets]
            bits = [sketch(values).view(np.int64).tolist() for values in least]
            marks = [signature(tokens) for tokens in sets]
            numbers = [[len(tokens) for tokens in sets], *([pair[at] for pair in of] for of in (marks, bits) for at in (0, 1))]
            taken = [(values >> np.uint64(16)).astype(np.uint32).view(np.int32) for values in least]
            columns = [*(pa.array(column, pa.int64()) for column in numbers), pa.array(taken, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return texts.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sketch_a long, sketch_b long, tokens array<int>")


def below(places: np.ndarray, paths: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes below: for each place (a row of ``tokens``) and path those of the chosen positions and the tokens there."""
    drawn = [mixed(mixed(paths ^ salt)) for salt in _SALTS]
    one, other = ((values % np.uint64(POSITIONS)).astype(np.int64) for values in drawn[:2])
    # 100 / percent positions on average.
    second = np.flatnonzero((drawn[2] % np.uint64(percent) < 100 - percent) & (one != other))
    places, paths = np.r_[places, places[second]], np.r_[paths, paths[second]]
    position = np.r_[one, other[second]]
    return places, mixed(mixed(mixed(paths ^ _ODD[position]) ^ tokens[places, position]))


def branches(rows: DataFrame, percent: int, trees: int, opened: list[Broadcast]) -> DataFrame:
    """``node, n, sketch_a, sketch_b, path``: the documents of the nodes below the open ones.

    Rows with a ``path`` are in that node. Others walk down from the roots, each in its own row, and the paths that are
    open on each level, sorted, tell where they go on: neither rows nor tokens are multiplied on the way.
    """
    names = ["node", "n", "sketch_a", "sketch_b"]
    placed = "path" in rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [broadcast.value for broadcast in opened]
        roots = mixed(np.arange(1, trees + 1, dtype=np.uint64) * _ODD[0])
        for batch in batches:
            size = batch.num_rows
            tokens = batch.column("tokens").flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(size, POSITIONS).astype(np.uint64)
            if placed:
                places, paths = np.arange(size), batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            else:
                places, paths = np.repeat(np.arange(size), trees), np.tile(roots, size)
            for open_ in levels:
                places, paths = below(places, paths, tokens, percent)
                there = np.searchsorted(open_, paths)
                kept = np.flatnonzero(open_[np.minimum(there, len(open_) - 1)] == paths)
                places, paths = places[kept], paths[kept]
            places, paths = below(places, paths, tokens, percent)
            columns = batch.select(names).take(pa.array(places)).columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array(paths.view(np.int64))], [*names, "path"])

    return rows.select(*names, "tokens", *(["path"] if placed else [])).mapInArrow(run, "node long, n long, sketch_a long, sketch_b long, path long")


def alike(a: str, b: str, percent: int) -> Column:
    """Whether two rows may be linked, by the sizes of their sets and by their sketches."""
    differing = sum((F.bit_count(F.col(f"{a}.sketch_{half}").bitwiseXOR(F.col(f"{b}.sketch_{half}"))) for half in "ab"), F.lit(0))
    sizes = [F.col(f"{side}.n") for side in (a, b)]
    return (F.least(*sizes) * 100 >= F.greatest(*sizes) * percent) & (POSITIONS - differing >= LEAST_ALIKE)


def candidates(points: DataFrame, folder: str, percent: int, trees: int) -> DataFrame:
    """``a, b``: pairs that met in a node and are alike by their sketches, from ``node, n, sketch_a, sketch_b, tokens``."""
    spark = points.sparkSession
    rows, found, opened, n_open = points, [], [], 0
    for level in range(1, DEPTH + 1):
        at = f"{folder}/level-{level}"
        branches(rows, percent, trees, opened).write.parquet(f"{at}/rows")
        here = spark.read.parquet(f"{at}/rows")
        sizes = here.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        here.join(sizes, "path").write.parquet(f"{at}/nodes")
        nodes = spark.read.parquet(f"{at}/nodes")
        small = nodes.filter(F.col("size") <= NODE).drop("size")
        met = small.alias("a").join(small.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.node") < F.col("b.node")) & alike("a", "b", percent))
        # Nodes lie in one partition each, so that the links of a tight one are as many as its documents, and not their pairs.
        stars(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))).write.parquet(f"{at}/met")
        found.append(f"{at}/met")
        large = nodes.filter(F.col("size") > NODE)
        if large.isEmpty():
            break
        centre = F.min(F.struct(F.xxhash64("node", "path").alias("h"), "node", "n", "sketch_a", "sketch_b")).alias("c")
        centres = large.groupBy("path").agg(centre).select("path", "c.*").drop("h")
        starred = large.alias("a").join(centres.alias("b"), F.col("a.path") == F.col("b.path"))
        starred.select("a.path", "a.node", F.col("b.node").alias("centre"), alike("a", "b", percent).alias("near")).write.parquet(f"{at}/starred")
        starred = spark.read.parquet(f"{at}/starred")
        stars(starred.filter("near").select(F.col("node").alias("a"), F.col("centre").alias("b"))).write.parquet(f"{at}/centred")
        found.append(f"{at}/centred")
        # All of a node alike its centre is one cluster whatever its branches say.
        starred.groupBy("path").agg(F.bool_and("near").alias("closed")).filter("NOT closed").select("path").write.parquet(f"{at}/open")
        paths = spark.read.parquet(f"{at}/open")
        n_open += paths.count()
        if n_open <= MOST_BROADCAST:
            # Each document walks down its open paths again, so that no tokens move.
            opened.append(spark.sparkContext.broadcast(np.sort(paths.toArrow()["path"].to_numpy().view(np.uint64))))
            if not len(opened[-1].value):
                break
        else:
            rows, opened = starred.join(paths, "path").select("node", "path").join(points, "node"), []
    return spark.read.parquet(*found)


def confirmed(sets: list[np.ndarray], label: np.ndarray, queries: Iterable[int], percent: int, before: bool) -> list[tuple[int, int]]:
    """Links between documents of different labels, by their full sets, as stars of what they join.

    ``label`` gives the first place of what is joined already. Each query meets all documents, or those ``before`` it, that are alike by their sketches, the most alike first.
    """
    given, label = label, label.copy()
    sizes = np.array([len(tokens) for tokens in sets], np.int64)
    bits = np.array([sketch(minwise(tokens)) for tokens in sets], np.uint64)
    for query in queries:
        equal = POSITIONS - np.bitwise_count(bits ^ bits[query]).sum(axis=1, dtype=np.int64)
        size = sizes[query]
        open_ = (equal >= LEAST_ALIKE) & (label != label[query]) & (100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size))
        if before:
            open_[query:] = False
        places = np.flatnonzero(open_)
        for other in places[np.argsort(-equal[places], kind="stable")].tolist():
            if label[other] != label[query]:
                common = len(np.intersect1d(sets[query], sets[other], assume_unique=True))
                if 100 * common >= percent * (size + sizes[other] - common):
                    label[label == label[other]] = label[query]
    moved = np.flatnonzero((given == np.arange(len(sets))) & (label != given))
    return list(zip(label[moved].tolist(), moved.tolist(), strict=True))


def confirm(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links within each unit of ``unit, part, cluster, node, label, asks, tokens``.

    Documents that ask meet all others of their cluster in the unit; labels tell what is joined already.
    """

    def run(group: pa.Table) -> pa.Table:
        names = ("cluster", "node", "label", "asks", "tokens")
        columns = {name: group.column(name).to_pylist() for name in names}
        rows = sorted({(cluster, node): at for at, (cluster, node) in enumerate(zip(columns["cluster"], columns["node"], strict=True))}.items())
        asks = {(cluster, node) for cluster, node, ask in zip(*(columns[name] for name in names[:2]), columns["asks"], strict=True) if ask}
        links: list[tuple[int, int]] = []
        start = 0
        while start < len(rows):
            end = start
            while end < len(rows) and rows[end][0][0] == rows[start][0][0]:
                end += 1
            ids = [node for (_, node), _ in rows[start:end]]
            sets = [np.frombuffer(columns["tokens"][at], np.uint64) for _, at in rows[start:end]]
            known = np.unique([columns["label"][at] for _, at in rows[start:end]], return_index=True, return_inverse=True)
            label = known[1][known[2]]
            queries = [place for place in range(end - start) if rows[start + place][0] in asks]
            links += [(ids[a], ids[b]) for a, b in confirmed(sets, label, queries, percent, before=len(queries) == end - start)]
            start = end
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("unit", "part").applyInArrow(run, "a long, b long")


def cluster_links(members: DataFrame, sets: DataFrame, folder: str, percent: int) -> DataFrame:
    """``a, b``: links that connect what is connected within clusters, from ``cluster, node, n`` and ``node, tokens``."""
    spark = members.sparkSession
    needed = F.greatest(F.ceil(F.sum("n") / CELL_TOKENS), F.ceil(F.count("*") / CELL_DOCUMENTS)).cast("int")
    cells = members.groupBy("cluster").agg(needed.alias("n_cells"))
    members.join(cells, "cluster").withColumn("cell", F.pmod(F.xxhash64("node"), F.col("n_cells")).cast("int")).write.parquet(f"{folder}/cells")
    placed = spark.read.parquet(f"{folder}/cells")
    facts = placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.max("n_cells").alias("most")).first()
    batches = 1 + 2 * facts["tokens"] // CELL_TOKENS
    is_large = F.col("n_cells") > 1
    unit = F.when(is_large, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(batches)))
    one = placed.select(unit.alias("unit"), F.when(is_large, F.col("cell")).otherwise(-1).alias("part"), "cluster", "node")
    large = placed.filter(is_large)
    shown = F.min(F.struct(F.xxhash64("node", F.lit(1)).alias("h"), "node")).alias("r")
    shown = large.groupBy("cluster", "n_cells", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(REPRESENTATIVES)).alias("slot")).agg(shown)
    everywhere = shown.select(F.col("cluster").alias("unit"), F.explode(F.sequence(F.lit(0), F.col("n_cells") - 1)).alias("part"), "cluster", F.col("r.node").alias("node"))
    first = one.unionByName(everywhere).select("*", F.col("node").alias("label"), F.lit(True).alias("asks"))
    confirm(sets.join(few_rows(first), "node"), percent).write.parquet(f"{folder}/links-1")
    links = spark.read.parquet(f"{folder}/links-1")
    if (facts["most"] or 1) <= 1:
        return links
    # Large clusters: the largest component of each is settled; what lies outside meets every cell.
    roots = connected(links).withColumnRenamed("root", "label")
    labelled = large.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counted = labelled.groupBy("cluster", "label").agg(F.count("*").alias("size")).groupBy("cluster").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    labelled.join(counted, "cluster").write.parquet(f"{folder}/labelled")
    labelled = spark.read.parquet(f"{folder}/labelled")
    outside = labelled.filter("label <> main")
    blocks = outside.groupBy("cluster").agg(needed.alias("n_blocks"))
    asking = outside.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("n_blocks")).cast("int"))
    columns = ["cluster", "node", "label", "block", "cell", "n_cells"]
    asked = asking.select(*columns[:4], F.explode(F.sequence(F.lit(0), F.col("n_cells") - 1)).alias("cell"), F.lit(True).alias("asks"))
    all_ = labelled.join(blocks, "cluster").select("cluster", "node", "label", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "cell", F.lit(False).alias("asks"))
    tiles = asked.unionByName(all_).withColumn("unit", F.xxhash64("cluster", "block")).withColumnRenamed("cell", "part").drop("block")
    confirm(sets.join(few_rows(tiles), "node"), percent).write.parquet(f"{folder}/links-2")
    return links.unionByName(spark.read.parquet(f"{folder}/links-2"))


def sets_of(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, tokens``: the full sets of the classes in ``wanted`` (``node, rep, set_a, set_b``).

    Rows that repeat an id and a set give theirs once a partition; who reads them by node takes any.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            rows = []
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = shingle_set(text, words)
                key = (rep, *signature(tokens))
                if key not in seen:
                    seen.add(key)
                    rows.append((*key, tokens.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], ["rep", "set_a", "set_b", "tokens"])

    small = few_rows(wanted)
    found = texts.join(small.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi")
    found = found.mapInArrow(run, "rep long, set_a long, set_b long, tokens binary")
    return found.join(small, ["rep", "set_a", "set_b"]).select("node", "tokens")


def few_rows(frame: DataFrame) -> DataFrame:
    """A slim frame to join with: broadcast if it has few rows."""
    return F.broadcast(frame) if frame.count() <= MOST_BROADCAST else frame


def near_documents(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: the smallest id reachable by links, itself included.

    Two documents link when the Jaccard similarity of their sets of ``words``-word shingles is at least ``percent`` / 100
    (50 to 99); each link is confirmed on the full sets. ``kept`` marks the documents that are the smallest of theirs.

    Ids must be integers. A text with fewer words is one shingle; an empty or null text has none, links with nothing and
    is kept. Rows that repeat an id are judged each by their text; those that repeat id and text share the verdict. A
    null id takes the smallest id of the rows with its very set, and is kept where there is none. An empty table gives
    no row; other columns are left out.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("ids must be integers")
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/chosen-path-{uuid.uuid4().hex}"
    texts = slim(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    set_marks(texts, words).write.parquet(f"{folder}/marks")
    marks = spark.read.parquet(f"{folder}/marks")
    key = ["set_a", "set_b", "n_shingles"]
    own = F.min(F.struct("doc_id", "sketch_a", "sketch_b", "tokens")).alias("m")
    classes = marks.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(own)
    # The number of a class stands in a written table, so it stays what it is.
    classes.select(F.monotonically_increasing_id().alias("node"), *key, F.col("m.doc_id").alias("rep"), "m.sketch_a", "m.sketch_b", "m.tokens").write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    points = classes.select("node", F.col("n_shingles").alias("n"), "sketch_a", "sketch_b", "tokens")
    clusters = connected(candidates(points, folder, percent, trees)).select("node", F.col("root").alias("cluster"))
    wanted = classes.drop("sketch_a", "sketch_b", "tokens").join(clusters, "node")
    wanted.write.parquet(f"{folder}/wanted")
    wanted = spark.read.parquet(f"{folder}/wanted")
    sets_of(texts, wanted.select("node", "rep", "set_a", "set_b"), words).write.parquet(f"{folder}/sets")
    links = cluster_links(wanted.select("cluster", "node", F.col("n_shingles").alias("n")), spark.read.parquet(f"{folder}/sets"), folder, percent)
    roots = connected(links).join(classes.select("node", "rep"), "node")
    smallest = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = roots.join(smallest, "root").select("node", "component_id")
    known = classes.select("node", *key, "rep").join(named, "node", "left").select(*key, F.coalesce("component_id", "rep").alias("component_id"))
    found = marks.select("doc_id", *key).join(known, key, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
