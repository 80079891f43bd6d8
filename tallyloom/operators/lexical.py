"""Lexical search: tokens, weighted overlap, BM25 and TF-IDF, all from lists of a document's tokens."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.segment import bigram_words as words

Tokenizer = Callable[[Column], Column]
#: BM25 parameters (fixed values).
K1, B = 1.2, 0.75
#: Units that stay with their number, and tokens that are never searched for (fixed values).
UNITS = ("kva", "kv", "kw", "hz", "db", "mω", "μs", "ms", "w", "v", "a", "s", "%")
STOP_TOKENS = ("nbsp", "table", "tr", "td", "th", "tbody", "thead", "colspan", "rowspan", "以及", "或者", "进行", "应按", "符合", "规定", "要求", "试验", "标准")
#: Dotted, slashed or dashed identifiers; numbers with a unit; dotted numbers.
_EXACT = r"[a-z][a-z0-9]*(?:[./\-][a-z0-9]+)+|[0-9]+(?:\.[0-9]+)?\s*(?:" + "|".join(UNITS) + r")|[0-9]+(?:\.[0-9]+)*"
#: Documents and queries of a block, words that are counted at once, and tokens of queries that tasks are sent to leave
#: out others.
DOCS, QUERIES, TOKENS, ASKED = 4096, 1024, 1 << 20, 50_000


def search_tokens(text: Column, tokenize: Tokenizer = words) -> Column:
    """Distinct lower-case tokens in order: words, then identifiers and measures squeezed to letters and digits.
    Markup and the stop list are left out, and single characters that are no digits."""
    plain = F.lower(F.translate(F.regexp_replace(text, "<[^>]+>", " "), "（）％", "()%"))
    exact = F.transform(F.regexp_extract_all(plain, F.lit(_EXACT), F.lit(0)), lambda t: F.regexp_replace(t, r"[^0-9a-z\p{IsHan}]+", ""))
    both = F.array_distinct(F.concat(tokenize(plain), exact))
    return F.filter(both, lambda t: ((F.length(t) >= 2) | t.rlike("^[0-9]$")) & ~t.isin(*STOP_TOKENS))


def _terms(queries: DataFrame, tokenize: Tokenizer) -> DataFrame:
    """query_id, token, qtf: a row for each distinct token of a query."""
    each = queries.select("query_id", F.explode(tokenize(F.coalesce("text", F.lit("")))).alias("token"))
    return each.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))


def _counter(asked: pa.Array | None):
    """Of rows (id, field, bag, w): w's length, and its distinct tokens, those among ``asked``, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("w")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, first = np.cumsum(size), 0
            while first < len(size):
                before = ends[first] - size[first]
                last = max(first + 1, int(np.searchsorted(ends, before + TOKENS, "right")))
                length = size[first:last]
                coded = lists.slice(first, last - first).flatten().dictionary_encode()
                names, code, row = coded.dictionary, coded.indices.to_numpy(), np.repeat(np.arange(len(length)), length)
                if asked is not None:
                    held = pc.is_in(names, value_set=asked).to_numpy(zero_copy_only=False)[code]
                    code, row = code[held], row[held]
                pair, tf = np.unique(row * max(1, len(names)) + code, return_counts=True)
                row, code = np.divmod(pair, max(1, len(names)))
                at = pa.array(np.searchsorted(row, np.arange(len(length) + 1)), pa.int32())
                tokens, counts = pa.ListArray.from_arrays(at, names.take(pa.array(code))), pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "field", "bag")), pa.array(length), tokens, counts], ["id", "field", "bag", "length", "tokens", "tf"])
                first = last

    return run


def counted(docs: DataFrame, columns: list[str], terms: DataFrame, tokenize: Tokenizer = words, id_col: str = "doc_id") -> DataFrame:
    """id, field, bag, length, tokens, tf: a row for each document and column (field is its place), with its number
    of words and lists of its distinct tokens and their counts. Counting goes row by row where texts are read, so
    no row is made for a word. Lists hold only tokens of ``terms`` where those are ASKED at most, and else all; what no
    query has finds nothing. ``bag`` tells different word lists of one id apart."""
    found = terms.select("token").distinct().limit(ASKED + 1).toArrow().column("token").combine_chunks()
    cut = docs.select(F.col(id_col).alias("id"), *[tokenize(F.coalesce(F.col(c), F.lit(""))).alias(f"w{i}") for i, c in enumerate(columns)])
    if len(columns) == 1:
        each = cut.select("id", F.lit(0).alias("field"), F.col("w0").alias("w"))
    else:
        each = cut.select("id", F.inline(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"w{i}").alias("w")) for i in range(len(columns))])))
    kind = docs.schema[id_col].dataType.simpleString()
    # In order, so that equal questions make equal plans.
    asked = found.take(pc.sort_indices(found)) if len(found) <= ASKED else None
    schema = f"id {kind}, field int, bag long, length long, tokens array<string>, tf array<int>"
    return each.select("id", "field", F.xxhash64("w").alias("bag"), "w").mapInArrow(_counter(asked), schema)


class _Block:
    """Documents of a block: postings (unit, code of token, tf), and each unit's document, length and field. Rows of
    one id, field and bag are one unit; with ``weights`` all of one id are, their counts weighted by field."""

    def __init__(self, rows: pa.Table, weights: list[float] | None):
        ids = rows.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(ids.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.ids, doc = ids.dictionary.take(pa.array(order)), rank[ids.indices.to_numpy()]
        self.field, self.lengths = (rows.column(c).to_numpy() for c in ("field", "length"))
        lists, tf = rows.column("tokens").combine_chunks(), rows.column("tf").combine_chunks().flatten().to_numpy().astype(float)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        self.tokens, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        if weights is None:
            _, one, unit = np.unique(np.stack([doc, self.field.astype(np.int64), rows.column("bag").to_numpy()], 1), axis=0, return_index=True, return_inverse=True)
            unit = unit.reshape(-1)
            self.doc, self.length, self.unit_field = doc[one], self.lengths[one], self.field[one]
        else:
            unit, self.doc = doc, np.arange(len(order))
            self.length, self.unit_field = np.bincount(doc, self.lengths, len(order)), np.zeros(len(order), int)
            tf = tf * np.repeat(np.array(weights)[self.field], size)
        of = np.repeat(unit, size)
        if len(self.doc) < len(doc):
            pair, back = np.unique(of * max(1, len(self.tokens)) + code, return_inverse=True)
            tf = np.bincount(back.reshape(-1), tf, len(pair))
            of, code = np.divmod(pair, max(1, len(self.tokens)))
        self.unit, self.code, self.tf, self.whole = of, code, tf, weights is not None


def _tallied(weights: list[float] | None):
    """Of a block of documents: by kind and token how many units have it ('df'), documents ('n'), words of those that
    have any ('words') and their number ('some')."""

    def run(rows: pa.Table) -> pa.Table:
        b = _Block(rows, weights)
        length = b.length if b.whole else b.lengths[b.field == 0]
        totals = {"n": int((b.field == 0).sum()), "words": int(length.sum()), "some": int((length > 0).sum())}
        df = np.bincount(b.code, minlength=len(b.tokens))
        kind, token = ["df"] * len(df) + list(totals), pa.concat_arrays([b.tokens.cast(pa.string()), pa.nulls(3, pa.string())])
        return pa.table({"kind": kind, "token": token, "v": pa.array([*df.tolist(), *totals.values()], pa.int64())})

    return run


def _saturated(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _fielded_idf(qtf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.fmax(np.log((n - df + 0.5) / (df + 0.5)), 1e-6)


#: By route: what a token weighs in a query, from its count there, its documents and all; and in a unit, from its
#: count there, the weight of the field, the unit's length and the mean. A score is the sum of products.
_WEIGHTS = {
    "bm25": (lambda qtf, df, n: np.log(1 + (n - df + 0.5) / (df + 0.5)), lambda tf, field, length, mean: _saturated(tf, length, mean)),
    "field_bm25": (_fielded_idf, lambda tf, field, length, mean: _saturated(tf, length, mean)),
    "tf_idf": (lambda qtf, df, n: (np.log((n + 1) / (df + 1)) + 1) * np.minimum(qtf, 2), lambda tf, field, length, mean: np.minimum(tf, 3) * field),
    "overlap": (lambda qtf, df, n: np.ones(len(qtf)), lambda tf, field, length, mean: field),
}


def _best(routes: list[str], k: int, weights: list[float], digits: int):
    """Of a block of documents and one of queries: each query's k best by each route. A query adds up the lists of its
    tokens over all documents of the block, so a frequent token makes no rows."""

    def run(rows: pa.Table, terms: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and terms.num_rows:
            b = _Block(rows, weights if "field_bm25" in routes else None)
            asked, code = pc.index_in(terms.column("token").combine_chunks(), value_set=b.tokens).fill_null(-1).to_numpy(), b.code
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(b.tokens) + 1))
            unit, tf = b.unit[order], b.tf[order]
            doc, field, length = b.doc[unit], np.array(weights, float)[b.unit_field[unit]], b.length[unit]
            coded = terms.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
            query = coded.indices.to_numpy()
            by = np.argsort(query, kind="stable")
            ends = np.searchsorted(query[by], np.arange(len(coded.dictionary) + 1))
            qtf, df, n, mean = (terms.column(c).to_numpy() for c in ("qtf", "df", "n", "mean"))
            by_route = []
            for route in routes:
                times, weigh = _WEIGHTS[route]
                by_route.append((route, times(qtf, df, n), weigh(tf, field, length, mean[0])))
            for i in range(len(coded.dictionary)):
                met = [t for t in by[ends[i] : ends[i + 1]] if asked[t] >= 0]
                if not met:
                    continue
                lists = [slice(cuts[asked[t]], cuts[asked[t] + 1]) for t in met]
                docs = np.concatenate([doc[x] for x in lists])
                for route, times, weight in by_route:
                    total = np.bincount(docs, np.concatenate([times[t] * weight[x] for t, x in zip(met, lists)]), len(b.ids))
                    some = np.flatnonzero(total > 0)
                    score = np.round(total[some], digits)
                    if len(some) > k:
                        near = score >= np.partition(score, -k)[-k]
                        some, score = some[near], score[near]
                    top = np.lexsort((some, -score))[:k]
                    out.append((np.full(len(top), i), some[top], score[top], [route] * len(top)))
        kinds = terms.schema.field("query_id").type, rows.schema.field("id").type
        if not out:
            return pa.table({"query_id": pa.array([], kinds[0]), "id": pa.array([], kinds[1]), "score": pa.array([], pa.float64()), "route": pa.array([], pa.string())})
        query, some, score = (np.concatenate([o[j] for o in out]) for j in range(3))
        return pa.table({"query_id": coded.dictionary.take(pa.array(query)), "id": b.ids.take(pa.array(some)), "score": score, "route": [r for o in out for r in o[3]]})

    return run


def ranked(docs: DataFrame, queries: DataFrame, k: int, routes: list[str], fields: dict[str, float], tokenize: Tokenizer = words, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank, route: each route's k best documents of each query (query_id, text), by the sum over
    its distinct tokens, rounded before ranking so that the order of a sum's terms decides no tie; ties to smaller ids.
    ``fields``: columns and their weights; more than one are for 'overlap', and for 'field_bm25', which goes alone.

    Documents and queries are dealt into blocks by a hash of the id; a pair of blocks is a task that keeps k rows a
    query and a route. What a document has is one row of lists, sent once for each block of queries, and no row is
    made for a document and a query. How many documents have a token is told from the same blocks and goes to the
    queries, so documents are never dealt by token."""
    n, m = docs.count(), queries.count()
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doc_blocks, query_blocks = max(1, math.ceil(n / DOCS), min(4 * parallel, math.ceil(n / 512))), max(1, math.ceil(m / QUERIES))
    deal = lambda c, b: F.pmod(F.xxhash64(c), F.lit(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    terms, weights = _terms(queries, tokenize), [float(w) for w in fields.values()]
    lists = counted(docs, list(fields), terms, tokenize).withColumn("db", deal("id", doc_blocks))
    if set(routes) == {"overlap"}:
        met = terms.withColumns({"df": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "mean": F.lit(1.0)})
    else:
        tally = lists.groupBy("db").applyInArrow(_tallied(weights if "field_bm25" in routes else None), "kind string, token string, v long").groupBy("kind", "token").agg(F.sum("v").alias("v"))
        total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("v")))
        totals = tally.agg(F.coalesce(total("n"), F.lit(0)).alias("n"), F.try_divide(total("words").cast("double"), total("some").cast("double")).alias("mean"))
        df = tally.filter("kind = 'df'").select(F.col("token").alias("t"), F.col("v").alias("df"))
        met = terms.join(df, F.col("token") == F.col("t")).drop("t").join(F.broadcast(totals))  # one row
    kind = queries.schema["query_id"].dataType.simpleString()
    # Columns of its own: a cogroup can't tell the sides apart where both come from the documents.
    right = met.select(*[F.col(c).alias(c) for c in ("query_id", "token", "qtf", "df", "n", "mean")]).withColumn("db", every(doc_blocks))
    keys = ["db"]
    if query_blocks > 1:  # one block of queries takes the documents as they were dealt for the counts
        keys, lists, right = ["db", "qb"], lists.withColumn("qb", every(query_blocks)), right.withColumn("qb", deal("query_id", query_blocks))
    found = lists.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(routes, k, weights, digits), f"query_id {kind}, id {docs.schema['doc_id'].dataType.simpleString()}, score double, route string")
    rank = F.row_number().over(Window.partitionBy("query_id", "route").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank", "route")


def bm25(docs: DataFrame, queries: DataFrame, k: int, tokenize: Tokenizer = words) -> DataFrame:
    """query_id, id, score, rank of the k best documents of each query. ``queries`` have query_id and text.

    Only tokens of queries are scored. A tokenizer with a dictionary comes from functions.segment."""
    return ranked(docs, queries, k, ["bm25"], {"text": 1.0}, tokenize).drop("route")


def field_bm25(docs: DataFrame, weights: dict[str, float], queries: DataFrame, k: int, tokenize: Tokenizer = words) -> DataFrame:
    """As bm25(), over several columns as a full-text index has it: a token's count is the weighted sum of its
    counts by column, a document's length that of all columns, and the weight of a token that most
    documents have is just above zero."""
    return ranked(docs, queries, k, ["field_bm25"], weights, tokenize).drop("route")


def tf_idf(docs: DataFrame, queries: DataFrame, k: int, weight: float = 1.0, tokenize: Tokenizer = words) -> DataFrame:
    """As bm25(), with weight * min(tf, 3) * idf * min(query tf, 2) and idf = ln((N + 1) / (df + 1)) + 1."""
    return ranked(docs, queries, k, ["tf_idf"], {"text": weight}, tokenize).drop("route")


def weighted_overlap(docs: DataFrame, fields: dict[str, float], queries: DataFrame, k: int, tokenize: Tokenizer = words) -> DataFrame:
    """As bm25(), with the sum over fields of weight times shared distinct tokens. No rows are cut before
    scoring."""
    return ranked(docs, queries, k, ["overlap"], fields, tokenize).drop("route")


def stale(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of ``index`` (id) whose chunk is gone or no longer approved."""
    c = chunks.select(F.col("id").alias("c_id"), "status")
    return index.join(c, F.col("id") == F.col("c_id"), "left").filter(F.col("c_id").isNull() | (F.col("status") != "approved")).select(*index.columns)


def pending(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``chunks`` (id, sha) whose hash is not the indexed one; not indexed counts as different."""
    i = index.select(F.col("id").alias("i_id"), F.col("sha").alias("i_sha"))
    return chunks.join(i, F.col("id") == F.col("i_id"), "left").filter(~F.col("sha").eqNullSafe(F.col("i_sha"))).select(*chunks.columns)
