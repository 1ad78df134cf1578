"""Chunking, vector top-k and evidence texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderspark.functions.common import blank_to_null, drop_blank, head, let, literals, strip
from tenderspark.operators.ranking import top_per_key
from tenderspark.session import stage

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd
    import pyarrow as pa

NO_BODY = "(No description provided for this RFP.)"
NO_PROJECT = "(Empty past performance row.)"
RULE = "\n\n---\n\n"
MAX_QUERY_CHARS = 12000
MAX_SECTION_CHARS = 80000
MAX_CONTEXT_CHARS = 200000
# "### Chunk 0", a line end, one character and the rule between chunks.
MIN_CHUNK_CHARS = 20
# Vectors of one side that stand for a cell of the grid at its least; cells grow as the root of the table.
CELL_ROWS = 2048
# Rows of each side in one matrix product, and hits kept before they are cut to the best `k`.
TILE = (1024, 4096)
HELD = 500_000
BLOCK_CHARS = 1024


# --- chunks ---------------------------------------------------------------------

def chunk_body(df: DataFrame, out: str = "body") -> DataFrame:
    """Titled sections of a notice, blank ones left out.

    Uses title, description, statement_of_work, deliverables and document_text.
    """
    def section(heading: str, text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(heading + ":\n"), text))

    listed = F.when(F.size(F.coalesce("deliverables", F.array().cast("array<string>"))) > 0, F.array_join("deliverables", "\n"))
    body = F.array_join(F.array(
        section("Title", strip("title")), section("Description", strip("description")),
        section("Statement of Work", strip("statement_of_work")), section("Deliverables", listed),
        section("Extracted Attachment Text", F.col("document_text"))), "\n\n")
    return df.withColumn(out, F.coalesce(blank_to_null(body), F.lit(NO_BODY)))


def chunk(df: DataFrame, ident: str = "notice_id", body: str = "body", target: int = 1200, overlap: int = 180) -> DataFrame:
    """Overlapping windows of each body: (ident, chunk_index, chunk_text).

    A window ends at its last blank line, else line end, past two fifths of it.
    Each window's place follows from the one before, so a fold over window numbers
    collects the spans; none moves on by less than two fifths of `target` less
    `overlap`, which bounds how many there are.  The text is cut into blocks of
    `BLOCK_CHARS` once, and a window is taken from the few blocks it lies in, so a
    long text isn't walked through again for each.
    """
    least = max(1, target * 2 // 5 - overlap)
    size, blocks = F.length("_text"), F.col("_blocks")

    def part(begin: Column, length: Column) -> Column:
        first = F.floor(begin / BLOCK_CHARS).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.lit(target // BLOCK_CHARS + 2)), "")
        return F.substring(near, begin - first * BLOCK_CHARS + 1, length)

    def step(acc, _):
        begin = acc["next"]
        near = F.lit(target - target * 2 // 5)

        def grown(backwards: Column) -> Column:
            blank, line = (F.locate(mark, backwards) for mark in ("\n\n", "\n"))  # from the window's end; 0: none
            stop = (F.when((blank > 0) & (blank + 1 < near), begin + target - blank + 1)
                    .when((line > 0) & (line < near), begin + target - line + 1).otherwise(begin + target))
            return let(stop, lambda at: F.struct(F.greatest(at - overlap, begin + 1).cast("int").alias("next"), F.concat(acc["spans"], spanned(begin, at)).alias("spans")))

        last = F.struct(F.lit(-1).alias("next"), F.concat(acc["spans"], spanned(begin, size)).alias("spans"))
        return F.when(begin < 0, acc).when(begin + target >= size, last).otherwise(let(F.reverse(part(begin, F.lit(target))), grown))

    def spanned(begin: Column, stop: Column) -> Column:
        return F.array(F.struct(begin.cast("int").alias("begin"), stop.cast("int").alias("stop")))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<begin:int,stop:int>>").alias("spans"))
    numbers = F.sequence(F.lit(0), F.floor(size / least).cast("int"))
    spans = F.aggregate(numbers, start, step, lambda acc: acc["spans"])
    cut = F.filter(F.transform("_spans", lambda s: strip(part(s["begin"], s["stop"] - s["begin"]))), lambda piece: piece != "")
    return (df.select(ident, strip(F.replace(F.coalesce(F.col(body), F.lit("")), F.lit("\r\n"), F.lit("\n"))).alias("_text"))
            .withColumn("_blocks", F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0)))
            .withColumn("_spans", spans).select(ident, F.posexplode(cut).alias("chunk_index", "chunk_text")))


def fixed_chunks(df: DataFrame, ident: str = "notice_id", body: str = "body", target: int = 1200, overlap: int = 180) -> DataFrame:
    """Fixed-width windows, without regard to line ends; stays in the JVM."""
    step = target - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(body) - target) / step), F.lit(0)).cast("int"))
    pieces = F.transform(starts, lambda i: F.substring(F.col(body), i * step + 1, F.lit(target)))
    return df.select(ident, F.posexplode(pieces).alias("chunk_index", "chunk_text"))


def missing_chunks(notices: DataFrame, chunks: DataFrame) -> DataFrame:
    """Notices without a single chunk."""
    return notices.join(chunks.select("notice_id"), "notice_id", "left_anti")


def missing_project_vectors(projects: DataFrame) -> DataFrame:
    """(project_id, text) of past projects that have no vector yet."""
    text = F.concat_ws("\n", blank_to_null("project_name"), blank_to_null("description"))
    return projects.filter(F.col("embedding").isNull()).select("project_id", F.coalesce(blank_to_null(text), F.lit(NO_PROJECT)).alias("text"))


def embedding_dims(df: DataFrame) -> DataFrame:
    return df.groupBy(F.size("embedding").cast("bigint").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def incomplete_embeddings(pieces: DataFrame, vectors: DataFrame, key: str = "notice_id") -> DataFrame:
    """(key, n_pieces, n_vectors): where not every piece that was sent has come back as a vector, or vectors have no piece."""
    sent = pieces.groupBy(key).agg(F.count(F.lit(1)).alias("n_pieces"))
    back = vectors.filter(F.col("embedding").isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_vectors"))
    both = sent.join(back, key, "full").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pieces", "n_vectors")])
    return both.filter("n_pieces <> n_vectors")


# --- vector top-k ------------------------------------------------------------------

def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column as rows of a matrix, and which of them have a length."""
    import numpy as np

    rows = [chunk for chunk in column.chunks if len(chunk)]
    if not rows:
        return np.empty((0, 0)), np.empty(0, dtype=bool)
    lengths = {n for chunk in rows for n in np.unique(chunk.value_lengths().to_numpy(zero_copy_only=False)).tolist()}
    if len(lengths) != 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths)}")
    x = np.concatenate([np.asarray(chunk.flatten().to_numpy(zero_copy_only=False), dtype="float64") for chunk in rows]).reshape(len(column), lengths.pop())
    norm = np.linalg.norm(x, axis=1)
    alive = norm > 0
    return x / np.where(alive, norm, 1.0)[:, None], alive


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, threshold: float, tiles: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(row, column, similarity) of the best `k` of each row of `q` over the tiles (rows of q, rows of x) that meet.

    Once a row has `k` hits only what reaches the last of them is kept.
    """
    import numpy as np

    floor = np.full(len(q), -np.inf)
    held: list[tuple[np.ndarray, ...]] = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
    size = 0

    def cut() -> None:
        rows, cols, sims = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((ids[cols], -sims, rows))
        rows, cols, sims = rows[order], cols[order], sims[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)  # rows are sorted: where each begins
        floor[rows[place == k - 1]] = sims[place == k - 1]
        keep = place < k
        held[:] = [(rows[keep], cols[keep], sims[keep])]

    for at, over in tiles:
        sims = q[at] @ x[over].T
        r, c = np.nonzero((sims > threshold) & (sims >= floor[at][:, None]))
        held.append((at[r], over[c], sims[r, c]))
        size += len(r)
        if size > HELD:
            cut()
            size = 0
    cut()
    return held[0]


def _grouped(codes: np.ndarray, of: np.ndarray) -> dict[int, np.ndarray]:
    """The entries of `of` by their code."""
    import numpy as np

    order = np.argsort(codes[of], kind="stable")
    rows = of[order]
    names, starts = np.unique(codes[rows], return_index=True)
    return dict(zip(names.tolist(), np.split(rows, starts[1:])))


def _part_tiles(left: pa.Table, right: pa.Table, mine: np.ndarray, theirs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tiles of the living rows of both sides, equal parts only."""
    import numpy as np
    import pandas as pd

    codes, _ = pd.factorize(np.concatenate([left["part"].to_pandas().to_numpy(), right["part"].to_pandas().to_numpy()]))
    asked, given = _grouped(codes[:left.num_rows], mine), _grouped(codes[left.num_rows:], theirs)
    for part, at in asked.items():
        over = given.get(part)
        if over is not None:
            for a in range(0, len(at), TILE[0]):
                for b in range(0, len(over), TILE[1]):
                    yield at[a:a + TILE[0]], over[b:b + TILE[1]]


def _meet(queries: DataFrame, items: DataFrame, k: int, threshold: float, partition: str | None = None,
          item_splits: int | None = None, query_splits: int | None = None, centroids: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """The best `k` of every query, over a grid of cells that hold a share of the queries and a share of the items.

    A vector goes to each cell of its row or column.  Both sides of a cell grow as
    the root of the table, and so do the copies.  Small partitions lie together in
    cells; a large one has a grid of its own.  With `centroids` a query meets only
    items whose nearest centroid is among its own `probes` nearest.
    """
    from math import ceil

    spark = queries.sparkSession
    kinds = dict(queries.dtypes)["query_id"], dict(items.dtypes)["item_id"]

    def side(df: DataFrame, ident: str) -> DataFrame:
        rows = df.filter(F.col("embedding").isNotNull()).select(
            (F.col(partition).cast("string") if partition else F.lit("")).alias("part"), F.col(ident).alias("ident"), F.col("embedding").alias("vector"))
        return rows.filter(F.col("part").isNotNull())

    def root(n: Column) -> Column:
        return F.ceil(F.sqrt(n / CELL_ROWS)).cast("int")

    q, i = side(queries, "query_id"), side(items, "item_id")
    if partition is None:
        rows = int(query_splits or max(1, ceil((queries.count() / CELL_ROWS) ** 0.5)))
        columns = int(item_splits or max(1, ceil((items.count() / CELL_ROWS) ** 0.5)))
        q, i = (df.select("*", F.lit(0).alias("bucket"), F.lit(rows).alias("_rows"), F.lit(columns).alias("_columns")) for df in (q, i))
    else:
        counted = q.groupBy("part").agg(F.count(F.lit(1)).alias("_q")).join(i.groupBy("part").agg(F.count(F.lit(1)).alias("_i")), "part")
        sizes = stage(counted, "part-sizes")
        large = stage(sizes.filter((F.col("_q") > CELL_ROWS) | (F.col("_i") > CELL_ROWS)).select("part", root(F.col("_q")).alias("_rows"), root(F.col("_i")).alias("_columns")), "large-parts")
        total = sizes.agg(F.sum(F.col("_q") + F.col("_i"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / (4 * CELL_ROWS)))
        q, i = (df.join(large, "part", "left").select("part", "ident", "vector", F.pmod(F.xxhash64("part"), F.lit(buckets)).cast("int").alias("bucket"),
                                                      F.coalesce("_rows", F.lit(1)).alias("_rows"), F.coalesce("_columns", F.lit(1)).alias("_columns")) for df in (q, i))
    own = lambda n: F.pmod(F.xxhash64("ident"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["part", "ident", "vector", "bucket", "_row", "_column"]
    q = q.withColumn("_row", own("_rows")).withColumn("_column", every("_columns")).select(*cols)
    i = i.withColumn("_column", own("_columns")).withColumn("_row", every("_rows")).select(*cols)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        (qv, mine), (iv, theirs) = _matrix(left["vector"]), _matrix(right["vector"])
        mine, theirs = np.flatnonzero(mine), np.flatnonzero(theirs)
        r, c, sim = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        if len(mine) and len(theirs):
            tiles = _part_tiles(left, right, mine, theirs) if centroids is None else _cell_tiles(qv, iv, mine, theirs, centroids, probes)
            r, c, sim = _nearest(qv, iv, right["ident"].to_pandas().to_numpy(), k, threshold, tiles)
        return pa.table({"query_id": left["ident"].take(pa.array(r)), "item_id": right["ident"].take(pa.array(c)), "sim": pa.array(sim)})

    keys = ["bucket", "_row", "_column"]
    hits = q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInArrow(best, f"query_id {kinds[0]}, item_id {kinds[1]}, sim double")
    return top_per_key(hits, ["query_id"], [F.col("sim").desc(), F.col("item_id")], k, rank="rank")


def topk_join(queries: DataFrame, items: DataFrame, k: int = 10, threshold: float = 0.7, partition: str | None = None,
              item_splits: int | None = None, query_splits: int | None = None) -> DataFrame:
    """The `k` items of greatest cosine similarity strictly above `threshold` for every query.

    `queries`: query_id, embedding; `items`: item_id, embedding; with `partition`
    both carry that column and only equal values meet.  Exact: every query meets
    every item in one cell of a grid, by matrix products, and a cell returns its
    best `k` per query.  Without `partition` the grid has `query_splits` x
    `item_splits` cells, the root of the rows by default.  Returns query_id,
    item_id, sim, rank.
    """
    return _meet(queries, items, k, threshold, partition, item_splits, query_splits)


def _some_vectors(df: DataFrame, ident: str, n: int) -> np.ndarray:
    """Unit vectors of `n` rows at most, chosen by a hash of their ids."""
    import numpy as np

    rows = df.filter(F.col("embedding").isNotNull()).select(F.xxhash64(ident).alias("h"), F.col("embedding").cast("array<double>").alias("e")).orderBy("h", "e").limit(n).collect()
    x = np.array([r["e"] for r in rows], dtype="float64")
    norm = np.linalg.norm(x, axis=1) if len(x) else np.empty(0)
    return x[norm > 0] / norm[norm > 0, None]


def fit_cells(items: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids by k-means on the sphere over `sample` items at most."""
    import numpy as np

    x = _some_vectors(items, "item_id", sample)
    if not len(x):
        return x
    rng = np.random.default_rng(seed)
    centroids = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[a:a + 4096] @ centroids.T, axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centroids)
    return centroids


def _cell_tiles(q: np.ndarray, x: np.ndarray, mine: np.ndarray, theirs: np.ndarray, centroids: np.ndarray, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tiles of living rows: the items of a centroid with the queries that have it among their `probes` nearest."""
    import numpy as np

    cell = np.zeros(len(x), dtype=np.int64)
    for a in range(0, len(theirs), TILE[0]):
        at = theirs[a:a + TILE[0]]
        cell[at] = np.argmax(x[at] @ centroids.T, axis=1)
    given = _grouped(cell, theirs)
    for a in range(0, len(mine), TILE[0]):
        at = mine[a:a + TILE[0]]
        near = q[at] @ centroids.T
        asked = np.zeros(near.shape, dtype=bool)
        np.put_along_axis(asked, np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < len(centroids) else np.broadcast_to(np.arange(len(centroids)), near.shape), True, axis=1)
        for c, over in given.items():
            some = at[asked[:, c]]
            if len(some):
                for b in range(0, len(over), TILE[1]):
                    yield some, over[b:b + TILE[1]]


def probes_needed(queries: DataFrame, items: DataFrame, centroids: np.ndarray, k: int, threshold: float, target: float, audited: int = 256) -> int:
    """How many nearest cells of a query hold the share `target` of its `k` nearest items, by `audited` queries compared with all items."""
    import numpy as np

    asked = _some_vectors(queries, "query_id", audited)
    if not len(asked):
        return 1
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # of each cell in a query's order
    kind = dict(items.dtypes)["item_id"]
    rows = items.filter(F.col("embedding").isNotNull()).select("item_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["embedding"].to_numpy())
            norm = np.linalg.norm(x, axis=1)
            ids, x = batch["item_id"].to_numpy()[norm > 0], x[norm > 0] / norm[norm > 0, None]
            sims = asked @ x.T
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(x) else np.broadcast_to(np.arange(len(x)), sims.shape)
            q, at = np.repeat(np.arange(len(asked)), top.shape[1]), top.reshape(-1)
            cell = np.argmax(x @ centroids.T, axis=1)
            keep = sims[q, at] > threshold
            yield pd.DataFrame({"q": q[keep], "item_id": ids[at[keep]], "sim": sims[q[keep], at[keep]], "place": place[q[keep], cell[at[keep]]]})

    found = rows.mapInPandas(best, f"q int, item_id {kind}, sim double, place int")
    # `k` rows for each audited query.
    places = [r["place"] for r in top_per_key(found, ["q"], [F.col("sim").desc(), F.col("item_id")], k).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect() for _ in range(r["n"])]
    if not places:
        return 1
    return int(np.sort(places)[max(0, int(np.ceil(target * len(places))) - 1)]) + 1


def topk_cells(queries: DataFrame, items: DataFrame, k: int = 10, threshold: float = 0.7, target: float = 0.95, cells: int | None = None,
               sample: int = 20_000, audited: int = 256) -> DataFrame:
    """As `topk_join`, but a query meets only the items of the cells nearest to it.

    Cells belong to centroids fitted on `sample` items at most; every item is in
    the cell of its nearest centroid.  How many cells a query looks into follows
    from an audit: `audited` queries are compared with all items, and the fewest
    cells that hold the share `target` of their results are taken.  Vectors
    without any structure need many cells, clustered ones few.  Similarities are
    exact.
    """
    n = items.count()
    # A query looks into a cell wherever a share of its items lies, so a vector is copied as often as in the exact search, not once for each probe.
    centroids = fit_cells(items, cells or max(1, min(4096, round(2 * n ** 0.5))), sample)
    if not len(centroids):
        return topk_join(queries, items, k, threshold)
    probes = probes_needed(queries, items, centroids, k, threshold, target, audited)
    return _meet(queries, items, k, threshold, centroids=centroids, probes=probes)


# --- evidence texts ------------------------------------------------------------------

def query_text(parts: Sequence[Column], cap: int = MAX_QUERY_CHARS) -> Column:
    """Non-blank parts, blank-line separated, up to the query length the vector service takes."""
    return F.left(strip(F.array_join(drop_blank(F.array(*parts)), "\n\n")), F.lit(cap))


def evidence_with_fallback(pairs: DataFrame, hits: DataFrame, notices: DataFrame) -> DataFrame:
    """Chunks found for each pair key, else the notice description.

    `pairs`: query_id, notice_id; `hits`: query_id, rank, chunk_text, sim; `notices`: notice_id, title, description.
    """
    found = pairs.join(hits, "query_id")
    bare = pairs.join(hits.select("query_id"), "query_id", "left_anti").join(notices, "notice_id") \
        .withColumn("chunk_text", F.left(F.coalesce("description", "title"), F.lit(4000))) \
        .select("query_id", "notice_id", F.lit(1).alias("rank"), "chunk_text", F.lit(0.0).alias("sim"))
    return found.select("query_id", "notice_id", "rank", "chunk_text", "sim").unionByName(bare)


def pair_excerpts(pairs: DataFrame, chunks: DataFrame, k: int = 6, threshold: float = 0.2) -> DataFrame:
    """(contractor_id, notice_id, rank, chunk_text, sim): for each pair the chunks of its own notice nearest to the pair's vector.

    `pairs`: contractor_id, notice_id, title, description, embedding; `chunks`:
    chunk_id, notice_id, chunk_text, embedding.  A pair without a chunk above the
    threshold, or without a vector, gets the notice's description, and where there
    is none its title.  One search partitioned by notice: pairs meet the chunks of
    their notice only; its few hits are staged, as two branches read them.
    """
    keys = ["contractor_id", "notice_id"]
    # The notice is part of the id, so an id belongs to one pair.
    asked = pairs.select(F.struct(*keys).alias("_pair"), F.to_json(F.struct(*keys)).alias("query_id"), F.col("notice_id").alias("part"), "embedding")
    items = chunks.select(F.col("chunk_id").alias("item_id"), F.col("notice_id").alias("part"), "embedding")
    hits = stage(topk_join(asked.drop("_pair"), items, k, threshold, partition="part"), "excerpt-hits")
    found = hits.join(asked.select("_pair", "query_id"), "query_id").join(chunks.select(F.col("chunk_id").alias("item_id"), "chunk_text"), "item_id") \
        .select("_pair.*", "rank", "chunk_text", "sim")
    bare = pairs.join(found.select(*keys).distinct(), keys, "left_anti") \
        .select(*keys, F.lit(1).alias("rank"), F.left(F.coalesce("description", "title"), F.lit(4000)).alias("chunk_text"), F.lit(0.0).alias("sim"))
    return found.unionByName(bare)


def pair_projects(pairs: DataFrame, past: DataFrame, k: int = 5, threshold: float = 0.2) -> DataFrame:
    """(contractor_id, notice_id, rank, project_id, project_name, description, sim): for each pair the contractor's own projects nearest to the notice's vector, else the first `k` on file.

    `pairs`: contractor_id, notice_id, embedding; `past`: contractor_id, project_id, project_name, description, embedding.
    """
    keys = ["contractor_id", "notice_id"]
    asked = pairs.select(F.struct(*keys).alias("_pair"), F.to_json(F.struct(*keys)).alias("query_id"), F.col("contractor_id").alias("part"), "embedding")
    items = past.select(F.col("project_id").alias("item_id"), F.col("contractor_id").alias("part"), "embedding")
    hits = stage(topk_join(asked.drop("_pair"), items, k, threshold, partition="part"), "project-hits")
    text = past.select("contractor_id", "project_id", "project_name", "description")
    found = hits.join(asked.select("_pair", "query_id"), "query_id").select("_pair.*", "rank", F.col("item_id").alias("project_id"), "sim").join(text.drop("contractor_id"), "project_id")
    filed = top_per_key(text, ["contractor_id"], [F.col("project_id")], k, rank="rank").withColumn("sim", F.lit(0.0))
    bare = pairs.select(*keys).join(found.select(*keys).distinct(), keys, "left_anti").join(filed, "contractor_id")
    cols = [*keys, "rank", "project_id", "project_name", "description", "sim"]
    return found.select(*cols).unionByName(bare.select(*cols))


def project_fallback(contractors: DataFrame, hits: DataFrame, past: DataFrame, n: int = 5) -> DataFrame:
    """Past projects found for each contractor, else the first `n` on file."""
    rest = past.join(hits.select("contractor_id"), "contractor_id", "left_anti").join(contractors.select("contractor_id"), "contractor_id", "left_semi")
    first = top_per_key(rest, ["contractor_id"], [F.col("project_id")], n, rank="rank").withColumn("sim", F.lit(0.0))
    cols = ["contractor_id", "project_id", "rank", "sim"]
    return hits.select(*cols).unionByName(first.select(*cols))


def _excerpt(text: Column) -> Column:
    return F.concat(F.left(text, F.lit(320)), F.when(F.length(text) > 320, F.lit("…")).otherwise(F.lit("")))


def citations(chunk_hits: DataFrame, project_hits: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, block, refs, excerpts): ranked excerpts under R1.. and P1.., joined by rule lines.

    Both inputs hold a bounded number of ranked rows per key.
    """
    sim = lambda: F.concat(F.lit("\n(similarity "), F.format_string("%.3f", F.col("sim")), F.lit(")\n"))
    r = chunk_hits.select(key, F.lit(0).alias("kind"), "rank", F.concat(F.lit("R"), F.col("rank")).alias("ref"),
                          F.col("chunk_text").alias("body"), F.lit("").alias("head"), "sim")
    name = F.coalesce(F.nullif("project_name", F.lit("")), F.lit("Past project"))
    body = F.concat_ws("\n", F.nullif("project_name", F.lit("")), F.nullif("description", F.lit("")))
    p = project_hits.select(key, F.lit(1).alias("kind"), "rank", F.concat(F.lit("P"), F.col("rank")).alias("ref"),
                            body.alias("body"), F.concat(F.lit(": "), name).alias("head"), "sim")
    parts = r.unionByName(p).withColumn("part", F.concat(F.lit("### "), "ref", "head", sim(), "body"))
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "ref", "part", _excerpt(F.col("body")).alias("excerpt")))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda e: e["part"]), RULE).alias("block"),
                       F.array_join(F.transform("x", lambda e: e["ref"]), " ").alias("refs"),
                       F.transform("x", lambda e: e["excerpt"]).alias("excerpts"))


def _line(label: str, value: Column) -> Column:
    text = strip(value.cast("string"))
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(label + ": "), text))


def context_document(notices: DataFrame, chunks: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """(notice_id, context): field lines, text sections and the notice's chunks in index order.

    Sections and the whole are cut at their limits, so no more chunks per
    notice are gathered than can fit into the chunk section.
    """
    def section(heading: str, body: Column) -> Column:
        text = strip(F.coalesce(body, F.lit("")))
        return F.when(text != "", F.concat(F.lit(f"## {heading}\n"), F.left(text, F.lit(MAX_SECTION_CHARS))))

    fitting = top_per_key(chunks, ["notice_id"], [F.col("chunk_index")], MAX_SECTION_CHARS // MIN_CHUNK_CHARS)
    part = F.concat(F.lit("### Chunk "), F.col("chunk_index").cast("string"), F.lit("\n"), F.col("chunk_text"))
    indexed = fitting.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("p")))).alias("_c")) \
        .select("notice_id", F.array_join(F.transform("_c", lambda e: e["p"]), RULE).alias("_chunks"))
    lines = F.array_join(F.array(*[_line(label, F.col(c)) for label, c in fields]), "\n")
    urls = F.array_join(F.array_distinct(drop_blank(F.transform("document_lines", strip))), "\n")
    joined = notices.join(indexed, "notice_id", "left")
    return joined.select("notice_id", F.left(F.array_join(F.array(
        section("Canonical RFP Fields", lines), section("Description", F.col("description")),
        section("Statement of Work", F.col("statement_of_work")), section("Deliverables", F.array_join("deliverables", "\n")),
        section("Attached Documents", urls), section("Source Metadata", F.col("metadata_json")),
        section("Extracted Attachment Text", F.col("document_text")), section("Indexed RFP Chunks", F.col("_chunks"))), "\n\n"),
        F.lit(MAX_CONTEXT_CHARS)).alias("context"))


def light_metadata(metadata: Column) -> Column:
    """Metadata JSON without the large text fields, from a map."""
    large = literals(("documents", "extracted_document_text", "extracted_document_texts"))
    return F.to_json(F.map_filter(metadata, lambda k, v: ~F.array_contains(large, k)))


def summary_requests(df: DataFrame) -> DataFrame:
    """(notice_id, request): the record text an outside summary service is given.

    Needs source, title, dept, event_type, solicitation_number, place_names,
    naics_codes, code_descriptions, labels, description, document_text.
    """
    bullet = lambda c, n: F.array_join(F.transform(drop_blank(F.transform(head(F.col(c), n), lambda x: strip(F.coalesce(x, F.lit(""))))),
                                                   lambda x: F.concat(F.lit("- "), x)), "\n")
    field = lambda label, v: F.concat(F.lit(label + ": "), F.coalesce(strip(v), F.lit("")))
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    optional = lambda heading, text: F.when(text != "", F.concat(F.lit(heading + ":\n"), text))
    clip = lambda c, n: F.coalesce(F.nullif(F.left(F.col(c), F.lit(n)), F.lit("")), F.lit("(none)"))
    return df.select("notice_id", F.array_join(F.array(
        F.lit("RECORD METADATA"), field("Source", F.col("source")), field("Title", F.col("title")),
        field("Issuing department / agency", F.col("dept")), field("Notice / event type", F.col("event_type")),
        field("Solicitation number", F.col("solicitation_number")), field("Place of performance", F.array_join(drop_blank(F.transform("place_names", strip)), ", ")),
        field("NAICS codes", listed("naics_codes")), optional("UNSPSC category descriptions", bullet("code_descriptions", 10)),
        optional("Attached document labels", bullet("labels", 25)), F.lit("\n---\nCLEANED DESCRIPTION (from website scrape):"),
        clip("description", 8000), F.lit("\n---\nATTACHED DOCUMENT TEXT (extracted from PDFs / DOCX):"), clip("document_text", 30000)), "\n").alias("request"))


def _numbered(df: DataFrame, keys: Sequence[str], text: Column, out: str) -> DataFrame:
    """Ranked rows of each key as one text in rank order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("_x")) \
        .select(*keys, F.array_join(F.transform("_x", lambda e: e["t"]), "\n\n").alias(out))


def experience_requests(pairs: DataFrame, excerpts: DataFrame, projects: DataFrame) -> DataFrame:
    """Judge requests of the experience factor: numbered excerpts and past projects per (contractor, notice).

    `pairs`: contractor_id, notice_id, title; `excerpts`: keys, rank, chunk_text; `projects`: keys, rank, project_name, description.
    """
    keys = ["contractor_id", "notice_id"]
    quoted = _numbered(excerpts, keys, F.concat(F.lit("### RFP excerpt "), F.col("rank"), F.lit("\n"), F.col("chunk_text")), "_e")
    done = _numbered(projects, keys, F.concat(F.lit("### Past project "), F.col("rank"), F.lit(": "), F.col("project_name"), F.lit("\n"),
                                              F.coalesce("description", F.lit("(no description)"))), "_p")
    none = F.lit("(Contractor has no past projects on file.)")
    return pairs.join(quoted, keys, "left").join(done, keys, "left").select(*keys, F.concat(
        F.lit("RFP: "), "title", F.lit("\n\n## Most relevant RFP excerpts\n"), F.coalesce("_e", F.lit("")),
        F.lit("\n\n## Contractor past performance\n"), F.coalesce("_p", none)).alias("request"))


def goals_requests(pairs: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Judge requests of the goals factor; `pairs` carries title and goals."""
    keys = ["contractor_id", "notice_id"]
    quoted = _numbered(excerpts, keys, F.concat(F.lit("### RFP excerpt "), F.col("rank"), F.lit("\n"), F.col("chunk_text")), "_e")
    return pairs.join(quoted, keys, "left").select(*keys, F.concat(
        F.lit("RFP: "), "title", F.lit("\n\n## Most relevant RFP excerpts\n"), F.coalesce("_e", F.lit("")),
        F.lit("\n\n## Contractor's stated goals\n"), F.coalesce(blank_to_null("goals"), F.lit("(empty)"))).alias("request"))


def requirement_requests(notices: DataFrame) -> DataFrame:
    """Requests to list the requirements of each notice that has a description."""
    return notices.filter(strip(F.coalesce("description", F.lit(""))) != "").select("notice_id", F.concat(
        F.lit("RFP: "), "title", F.lit("\n\n## Description\n"), F.left(strip("description"), F.lit(MAX_QUERY_CHARS))).alias("request"))


def prereq_requests(pairs: DataFrame, requirements: DataFrame, contractors: DataFrame, past: DataFrame) -> DataFrame:
    """Judge requests of the textual prerequisites.

    `requirements`: notice_id, rank, requirement; `past`: contractor_id, rank, project_name, description, tags (ranked, bounded).
    """
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("(none)"))
    needs = requirements.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("rank"), F.lit(". "), "requirement").alias("t")))).alias("_x")) \
        .select("notice_id", F.array_join(F.transform("_x", lambda e: e["t"]), "\n").alias("_needs"))
    done = _numbered(past, ["contractor_id"], F.concat(F.lit("### Past project "), F.col("rank"), F.lit(": "), F.col("project_name"), F.lit("\nTags: "), listed("tags"),
                                                     F.lit("\n"), F.coalesce("description", F.lit(""))), "_past")
    profile = contractors.select("contractor_id", F.concat(
        F.lit("Certifications held: "), listed("certifications"), F.lit("\nSet-aside eligibility: "), listed("set_aside_eligibility"),
        F.lit("\nIndustries: "), listed("industries"), F.lit("\nSub-industries: "), listed("sub_industries")).alias("_profile"))
    return pairs.join(needs, "notice_id").join(profile, "contractor_id").join(done, "contractor_id", "left").select(
        "contractor_id", "notice_id", F.concat(F.lit("RFP: "), "title", F.lit("\n\n## Requirements to evaluate\n"), "_needs", F.lit("\n\n## Contractor profile\n"),
                                               "_profile", F.lit("\n\n## Past projects\n"), F.coalesce("_past", F.lit("(none)"))).alias("request"))


def reasoning_requests(scored: DataFrame) -> DataFrame:
    """Requests to explain a finished score; `scored` has title, company_name, total and factor_lines (array)."""
    return scored.select("contractor_id", "notice_id", F.concat(
        F.lit("Contractor: "), "company_name", F.lit("\nRFP: "), "title", F.lit("\nOverall score: "), F.col("total").cast("string"),
        F.lit("/100\n\nFactor breakdown:\n"), F.array_join("factor_lines", "\n")).alias("request"))
