"""A lexical index with positions, published as a version, and queries of words, phrases and boolean operators over it.

``postings`` has a row for each term and chunk: how often, where, and the length of the chunk. It is made of runs, each the
inverted texts of some chunks in the order of their terms, so that the statistics of pages lead to the rows of a term in
each run and no posting is shuffled; the first row of a term in a run also has how many there are. ``chunks`` has the ids of
the chunks with words, ``terms`` the document frequency of each term, ``totals`` the number and the mean length of the
chunks. The manifest binds the index to the chunks that it was built from.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators.retrieval import bm25_part
from sessionloom.sources import versions
from sessionloom.sources.shared import shared_dir
from sessionloom.sources.versions import Drift, Version

#: Bytes of texts that a run inverts, about; a longer text is a run of its own.
RUN_BYTES = 1 << 24
#: Rows of a run that are handed to Spark at once.
RUN_ROWS = 1 << 15
#: Words hardly repeat in a run, so a dictionary of them is of no use; short pages leave little beside a term to read.
PAGES = {"parquet.enable.dictionary#term": "false", "parquet.page.row.count.limit": "4096"}
GENERATION = 4
#: Bytes of words besides the two-byte letters à to ÿ without ÷, and the most bytes of a word.
_PLAIN = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))
WORD_BYTES = 40


#: A light stem: a plural s and the endings ing and ed go where three letters and more are left.
STEM = ((r"^(.{3,}[^s])s$", r"\1"), (r"^(.{3,})(?:ing|ed)$", r"\1"))


def stemmed(term: Column) -> Column:
    """The light stem of a term."""
    for pattern, kept in STEM:
        term = F.regexp_replace(term, pattern, kept.replace("\\", "$"))
    return term


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each string begins and the last ends."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, cut where the texts of a piece would be longer than ``RUN_BYTES``."""
    held, size = [], 0
    for batch in batches:
        ends, at = _texts(batch.column("text"))[1], 0
        while at < len(batch):
            upto = int(np.searchsorted(ends, ends[at] + RUN_BYTES - size, side="right")) - 1
            if upto > at or not held:
                upto = max(upto, at + 1)
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto] - ends[at])
                at = upto
            if at < len(batch) or size >= RUN_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words_in(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased texts, each text with a blank at its end, one after the other, and how many each text has."""
    data, ends = _texts(column)
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = _PLAIN[data]
    second = np.flatnonzero(data == 0xC3) + 1
    second = second[(data[second] >= 0xA0) & (data[second] != 0xB7)]
    inside[second] = inside[second + 1] = True
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[inside[1:]]))
    if (sizes > WORD_BYTES).any():
        words, starts = words.filter(pa.array(sizes <= WORD_BYTES)), starts[sizes <= WORD_BYTES]
    return words, np.diff(np.searchsorted(starts, ends))


def _inverted(stem: bool):
    """Of chunks (id, text) the postings (id, term, tf, at, length, in_run), sorted by term within each run."""

    def invert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            words, lengths = words_in(piece.column("text"))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            terms = coded.dictionary
            if stem:
                for pattern, kept in STEM:
                    terms = pc.replace_substring_regex(terms, pattern, kept)
            sorted_terms = pc.unique(terms).sort()
            rank = pc.index_in(terms, sorted_terms).to_numpy()
            # the words by term, within a term as they come
            keys = (rank[coded.indices.to_numpy()].astype(np.int64) << 32) | np.arange(len(words))
            keys.sort()
            term, word = keys >> 32, keys & 0xFFFFFFFF
            chunk = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[word]
            at = word - np.repeat(np.cumsum(lengths) - lengths, lengths)[word]
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])]))
            bounds = np.append(first, len(words)).astype(np.int32)
            where, heads = chunk[first], np.flatnonzero(np.diff(term[first], prepend=-1))
            in_run = np.zeros(len(first), np.int32)
            in_run[heads] = np.diff(heads, append=len(first))
            columns = {"id": piece.column("id").take(pa.array(where)), "term": sorted_terms.take(pa.array(term[first])), "tf": np.diff(bounds).astype(np.int64)}
            columns |= {"at": pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32))), "length": lengths[where].astype(np.int32), "in_run": pa.array(in_run, mask=in_run == 0)}
            yield from pa.table(columns).to_batches(max_chunksize=RUN_ROWS)

    return invert


def build(chunks: DataFrame, root: str, stem: bool = False, facts: dict | None = None) -> Version:
    """Indexes chunk_id and text of ``chunks`` as the next version below ``root``.

    The chunks are dealt over as many tasks as there are shuffle partitions, and each inverts its own in runs of bounded size.
    """
    spark = chunks.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = {"generation": GENERATION, "source": versions.stamp(chunks), "stem": stem} | (facts or {})
    texts = chunks.select(F.col("chunk_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    lowered = texts.repartition(tasks, "id").select("id", F.concat(F.lower("text"), F.lit(" ")).alias("text"))  # a file's rows may be one task
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    count = texts.agg(F.count("*").alias("n"))
    tables = {
        "postings": lowered.mapInArrow(_inverted(stem), f"id {kind}, term string, tf long, at array<int>, length int, in_run int"),
        "terms": lambda done: done["postings"].where("in_run is not null").groupBy("term").agg(F.sum("in_run").alias("df")),
        "chunks": lambda done: done["postings"].where(F.get("at", F.lit(0)) == 0).groupBy("id").agg(F.sum("length").alias("length")),  # a chunk's first word
        "totals": lambda done: count.crossJoin(done["chunks"].agg(F.sum("length").alias("words"))).select("n", F.try_divide(F.coalesce("words", F.lit(0)), "n").alias("mean")),  # one row each
    }
    return versions.publish(spark, root, tables, told, options={"postings": PAGES})


def checked(spark: SparkSession, root: str, chunks: DataFrame | None = None, **facts) -> Version:
    """The newest index of ``root``; an error that says what does not fit: missing, generation, source, or one of ``facts``."""
    found = versions.read(spark, root)
    if found is None:
        raise Drift("missing", f"no index below {root}")
    if found.facts.get("generation") != GENERATION:
        raise Drift("generation", f"index of generation {found.facts.get('generation')}")
    for name, value in facts.items():
        if found.facts.get(name) != value:
            raise Drift(name, f"index has {found.facts.get(name)!r}, asked for {value!r}")
    if chunks is not None and found.facts.get("source") != versions.stamp(chunks):
        raise Drift("source", "the chunks have changed since the index was built")
    return found


def root_of(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sessionloom/index-{re.sub('[^0-9A-Za-z]+', '-', name).strip('-')}"


def kept_index(spark: SparkSession, name: str, chunks: DataFrame) -> Version:
    """The index of ``chunks`` below the shared folder, built anew where there is none or the chunks have changed."""
    root = root_of(spark, name)
    try:
        return checked(spark, root, chunks)
    except Drift:
        return build(chunks, root)


def postings_of(spark: SparkSession, index: Version, terms: list[str]) -> DataFrame:
    """The postings of these terms; of each run only the pages of the terms are read."""
    return index.table(spark, "postings").where(F.col("term").isin(list(terms)))


def frequencies(spark: SparkSession, index: Version, terms: list[str]) -> DataFrame:
    return index.table(spark, "terms").where(F.col("term").isin(list(terms)))


def totals(spark: SparkSession, index: Version) -> DataFrame:
    return index.table(spark, "totals")


# Queries


@dataclass(frozen=True)
class Node:
    """A query: kind is term, phrase, and, or, not, all; ``words`` of a term or phrase, ``parts`` of the others."""

    kind: str
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()


_TOKEN = re.compile(r'\s*(?:"([^"]*)"|(\()|(\))|(AND|OR|NOT)(?![^\s()"])|([^\s()"]+))')


def _words(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[^0-9a-zà-öø-ÿ]+", text.lower()) if w and len(w.encode()) <= 40)


def parse(query: str) -> Node:
    """A query as a tree: words side by side are alternatives; +word must be there, -word must not; "a phrase"; AND binds
    closer than OR, NOT and - before a part leave it out; brackets. What cannot be read is an error with its place."""
    tokens, at = [], 0
    while query[at:].strip():
        found = _TOKEN.match(query, at)
        if not found:
            raise ValueError(f"cannot read the query at {at}: {query[at:]!r}")
        tokens.append((found.lastindex, found[found.lastindex]))
        at = found.end()
    tokens.append((0, ""))
    place = 0

    def peek():
        return tokens[place]

    def take():
        nonlocal place
        place += 1
        return tokens[place - 1]

    def leaf(text: str) -> Node | None:
        words = _words(text)
        return Node("phrase", words) if len(words) > 1 else Node("term", words) if words else None

    def atom() -> tuple[str, Node | None]:
        kind, text = take()
        if kind == 4 and text == "NOT":
            return "-", atom()[1]
        if kind == 1:
            return "", leaf(text)
        if kind == 2:
            inner = either()
            if take()[0] != 3:
                raise ValueError("a bracket is not closed")
            return "", inner
        if kind == 5:
            sign = text[0] if text[0] in "+-" else ""
            rest = text[len(sign) :]
            return (sign, leaf(rest)) if rest else (sign, atom()[1])
        raise ValueError(f"a part is missing before {text!r}")

    def together() -> list[tuple[str, Node]]:
        parts = [atom()]
        while peek() == (4, "AND"):
            take()
            parts.append(atom())
        if len(parts) == 1:
            return [p for p in parts if p[1]]
        made = [Node("not", parts=(n,)) if s == "-" else n for s, n in parts if n]
        return [("", Node("and", parts=tuple(made)))] if made else []

    def either() -> Node | None:
        clauses = together()
        while peek()[0] not in (0, 3):
            if peek() == (4, "OR"):
                take()
            clauses += together()
        need, may, leave = ([n for s, n in clauses if s == k] for k in ("+", "", "-"))
        if not need and not may and not leave:
            return None
        found = Node("and", parts=tuple(need)) if len(need) > 1 else need[0] if need else None
        if not need:
            found = Node("or", parts=tuple(may)) if len(may) > 1 else may[0] if may else Node("all")
        if leave:
            found = Node("and", parts=(found, *(Node("not", parts=(n,)) for n in leave)))
        return found

    tree = either() if len(tokens) > 1 else None
    if peek()[0] == 3:
        raise ValueError("a bracket is closed that was not opened")
    return tree or Node("or")


def leaves(tree: Node) -> list[str]:
    """The words of a tree that count for the score: all but those that are left out."""
    if tree.kind == "not":
        return []
    return sorted({*tree.words, *(w for p in tree.parts for w in leaves(p))})


def _holds(tree: Node, count, places) -> Column:
    """Whether a chunk matches; ``count`` and ``places`` give the postings of a word there and where it stands."""
    if tree.kind == "term":
        return count(tree.words[0]) > 0
    if tree.kind == "phrase":
        starts = places(tree.words[0])  # the places where the phrase would begin
        for offset, word in enumerate(tree.words[1:], 1):
            starts = F.array_intersect(starts, F.transform(places(word), lambda p: p - offset))  # noqa: B023  called at once
        return F.size(starts) > 0
    parts = [_holds(p, count, places) for p in tree.parts]
    if tree.kind == "not":
        return ~parts[0]
    joined = F.lit(tree.kind != "or")
    for part in parts:
        joined = joined | part if tree.kind == "or" else joined & part
    return joined


def _needs_none(tree: Node) -> bool:
    """Whether a chunk without any word of the tree matches."""
    if tree.kind in ("term", "phrase"):
        return False
    parts = [_needs_none(p) for p in tree.parts]
    return {"not": lambda: not parts[0], "or": lambda: any(parts)}.get(tree.kind, lambda: all(parts))()


def matching_each(spark: SparkSession, index: Version, trees: dict[str, Node]) -> DataFrame:
    """(query, id, score): the chunks that each query matches, by BM25 over its words with the index's frequencies.

    The postings of all words are read once and meet in one row a chunk, where a query is a condition.
    """
    nodes = [n for t in trees.values() for n in _nodes(t)]
    words, in_phrases = sorted({w for n in nodes for w in n.words}), {w for n in nodes if n.kind == "phrase" for w in n.words}
    name = {w: str(i) for i, w in enumerate(words)}
    rows = postings_of(spark, index, words).join(F.broadcast(frequencies(spark, index, words)), "term").crossJoin(F.broadcast(totals(spark, index)))  # a row a word; one row
    of = lambda w, x: F.when(F.col("term") == w, F.col(x))
    found = [f(w).alias(k + name[w]) for w in words for k, f in (("n", lambda w: F.count(of(w, "term"))), ("score", lambda w: F.sum(of(w, "part"))))]
    found += [F.flatten(F.collect_list(of(w, "at"))).alias("at" + name[w]) for w in words if w in in_phrases]
    chunks = rows.select("id", "term", "at", bm25_part().alias("part")).groupBy("id").agg(F.count("*").alias("postings"), *found)
    if any(map(_needs_none, trees.values())):
        chunks = index.table(spark, "chunks").select("id").join(chunks, "id", "left")
    count = lambda w: F.coalesce("n" + name[w], F.lit(0))
    places = lambda w: F.coalesce("at" + name[w], F.array().cast("array<int>"))
    score = lambda tree: F.round(sum((F.coalesce("score" + name[w], F.lit(0.0)) for w in leaves(tree)), F.lit(0.0)), 6)
    hits = [F.when(_holds(t, count, places), F.struct(F.lit(q).alias("query"), score(t).alias("score"))) for q, t in trees.items()]
    return chunks.select("id", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("hit.query", "id", "hit.score")


def matching(spark: SparkSession, index: Version, tree: Node) -> DataFrame:
    """(id, score): the chunks that a query matches."""
    return matching_each(spark, index, {"": tree}).select("id", "score")


def search(spark: SparkSession, index: Version, query: str, limit: int = 10) -> DataFrame:
    """(id, score, rank) of the best matches of a query; ties by id; ranks from 0."""
    from pyspark.sql import Window

    tree = parse(query)
    if index.facts.get("stem"):
        tree = _stemmed(spark, tree)
    best = matching(spark, index, tree).orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1)  # at most limit rows


def _stemmed(spark: SparkSession, tree: Node) -> Node:
    """The tree with its words stemmed as the index's are."""
    words = sorted({w for n in _nodes(tree) for w in n.words})
    stems = dict(spark.createDataFrame([(w,) for w in words], "w string").select("w", stemmed(F.col("w"))).collect()) if words else {}
    swap = lambda n: Node(n.kind, tuple(stems[w] for w in n.words), tuple(map(swap, n.parts)))
    return swap(tree)


def _nodes(tree: Node) -> list[Node]:
    return [tree, *(n for p in tree.parts for n in _nodes(p))]
