"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A state holds the longest suffix of the text read that begins some piece, and for each position inside it the last token
of the tokenization up to there and how many tokens that has fewer. Reading a character finds the one piece that can end
there: a suffix whose predecessor it may follow, that is, merging the two alone leaves the two. The transition carries the
change of the token count. There are finitely many states; those that texts reach are compiled when first met.

Where a piece cannot span two neighbouring characters the state forgets what was before. No piece has a space mark behind
another character or anything but a letter behind a letter, so the texts between such places are transitions of their own;
this is checked when a vocabulary is compiled.

A chunk of text is a map from the state that it is entered in to the state that it is left in and the tokens between. Such
maps compose associatively. The chunks of a long text are rows of their own: each is mapped for the state to which the
characters before it lead from the start, and a prefix scan over the chunks of a text checks that each is entered in the
state that the one before is left in and adds the tokens. Where that fails, as in a long run of one character, the maps of
that text are applied one after another.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.shared import narrow_side, written

LIMIT = 4096
#: Characters of a chunk, and of the text before it that lead to the state in which it is entered.
BLOCK = 1 << 16
WARM = 512
#: States that a task keeps, and words with their counts, before it begins anew.
STATES = 200_000
WORDS = 500_000
MARK = "▁"
_LETTER, _OTHER = r"[^\W\d_]", rf"(?:(?!{MARK})[\W\d_])"

State = tuple[str, tuple[tuple[str | None, int], ...]]
START: State = ("", ((None, 0),))


class Transducer:
    """Counts tokens of texts under the pieces and their scores (greater merges first)."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        self.pairs = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        self.by_word = not any(a != MARK and b == MARK for a, b in self.pairs)
        letter = re.compile(_LETTER).match
        by_letter = self.by_word and not any(letter(a) and not letter(b) for a, b in self.pairs)
        finer = f"{MARK}+{_OTHER}*{_LETTER}*|{_OTHER}+{_LETTER}*|{_LETTER}+"
        self.chunks = re.compile(finer if by_letter else f"{MARK}+[^{MARK}]*|[^{MARK}]+" if self.by_word else "(?s).+").findall
        self.ranks = {p: -score for p, score in scores.items()}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.follows: dict[tuple[str | None, str], bool] = {}
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets all states but the first."""
        self.states: list[State] = [START]
        self.numbers: dict[State, int] = {self.states[0]: 0}
        #: By state and character: the next state, times 64, plus 32, plus the change of the token count.
        self.moves: list[dict[str, int]] = [{}]

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by its merges: of all neighbours that form a piece the best first, then leftmost."""
        parts = list(text)
        while True:
            found = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a piece joins; None for a character or a piece that merges never reach."""
        if piece not in self.halves:
            parts, before = list(piece), []
            while len(parts) > 1:
                found = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks), default=None)
                if not found:
                    break
                before, i = parts, found[1]
                parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
            self.halves[piece] = (before[0], before[1]) if len(parts) == 1 and before else None
        return self.halves[piece]

    def may_follow(self, last: str | None, piece: str) -> bool:
        """Whether ``piece`` is a token behind the token ``last``.

        The merges that make the two are undone, the latest first. At each stage the symbols that touch must not form a
        piece that would have been merged before the merge undone last: better, or as good and further left.
        """
        known = self.follows.get((last, piece))
        if known is None:
            known = len(piece) == 1 or self.split(piece) is not None
            if known and last:
                known = self._apart(last, piece)
            self.follows[last, piece] = known
        return known

    def _apart(self, left: str, right: str) -> bool:
        ranks, never = self.ranks, float("inf")
        undone, on_right = never, False
        while True:
            joint = ranks.get(left + right, never)
            if joint < undone or (joint == undone != never and on_right):
                return False
            one = ranks[left] if len(left) > 1 else -never
            two = ranks[right] if len(right) > 1 else -never
            if one == two == -never:
                return True
            # of merges of equal rank the right one is later
            if two >= one:
                undone, on_right, right = two, True, self.split(right)[0]
            else:
                undone, on_right, left = one, False, self.split(left)[1]

    def compile(self, number: int, char: str) -> int:
        """The move from a state by a character that it has not met."""
        suffix, tail = self.states[number]
        suffix += char
        while suffix and suffix not in self.prefixes:
            suffix = suffix[1:]
        last, count = None, len(char.encode()) + tail[-1][1]  # a character without a piece becomes its bytes
        for size in range(len(suffix), 0, -1):
            before, fewer = tail[-size]
            if suffix[-size:] in self.scores and self.may_follow(before, suffix[-size:]):
                last, count = suffix[-size:], fewer + 1
                break
        kept = [(None, 0)] * len(suffix) + [(last, 0)]
        for i, (before, fewer) in enumerate(tail[len(tail) - len(suffix) :] if suffix else ()):
            if suffix[i:] in self.prefixes:  # else no piece that is still open begins here
                joins = before and before[-1] + suffix[i] in self.pairs
                kept[i] = (before if joins else None, fewer - count)
        if not suffix:
            kept = [(None, 0)]
        state = (suffix, tuple(kept))
        to = self.numbers.setdefault(state, len(self.states))
        if to == len(self.states):
            self.states.append(state)
            self.moves.append({})
        self.moves[number][char] = found = to * 64 + 32 + count
        return found

    def word(self, text: str) -> int:
        if len(self.states) > STATES:
            self.reset()
        moves, number, total = self.moves, 0, 0
        for char in text:
            move = moves[number].get(char)
            if move is None:
                move = self.compile(number, char)
            number = move >> 6
            total += (move & 63) - 32
        if len(text) <= 64:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[text] = total
        return total

    def tokens(self, marked: str) -> int:
        words, word = self.words, self.word
        return sum([words[c] if c in words else word(c) for c in self.chunks(marked)])

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after ``text`` and its tokens, character by character."""
        if len(self.states) > STATES:
            self.reset()
        number, total = self.numbers.setdefault(state, len(self.states)), 0
        if number == len(self.states):
            self.states.append(state)
            self.moves.append({})
        for char in text:
            move = self.moves[number].get(char)
            if move is None:
                move = self.compile(number, char)
            number = move >> 6
            total += (move & 63) - 32
        return self.states[number], total

    def map(self, chunk: str, entry: State) -> tuple[State, int]:
        """The state in which a chunk is left and its tokens, if it is entered in this state."""
        cuts = re.search(f"(?<=[^{MARK}]){MARK}", chunk) if self.by_word else None
        if not cuts:
            return self.run(entry, chunk)
        first, last = cuts.start(), len(chunk)
        while True:  # the last word start
            last = chunk.rindex(MARK, 0, last)
            if chunk[last - 1] != MARK:
                break
        _, before = self.run(entry, chunk[:first])
        exit, after = self.run(START, chunk[last:])
        return exit, before + self.tokens(chunk[first:last]) + after

    def count(self, text: str, block: int = BLOCK) -> int:
        """Tokens of a whole text, with the space mark that is put before it; none for an empty text."""
        if not text:
            return 0
        text = marked(text)
        if len(text) <= block:
            return self.tokens(text)
        state, total = START, 0
        for at in range(0, len(text), block):
            state, n = self.map(text[at : at + block], state)
            total += n
        return total


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def compile_model(path: str) -> Transducer:
    """The transducer of a sentencepiece BPE model with byte fallback and no normalization."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return Transducer({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not special(i)})


_COMPILED: dict[str, Transducer] = {}


def _transducer(model_path: str) -> Transducer:
    if model_path not in _COMPILED:
        _COMPILED[model_path] = compile_model(model_path)
    return _COMPILED[model_path]


def chunk_maps(texts: DataFrame, model_path: str, block: int = BLOCK, warm: int = WARM) -> DataFrame:
    """(key, chunk, entry, exit, n): the maps of the chunks of the texts, each for the state that its warm-up leads to.

    ``texts`` has (key, text); the chunks are dealt over all tasks, so that one very long text is not one task's work.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column("key"), batch.column("text"), strict=True):
                text = marked(value.as_py())
                for at in range(0, len(text), block):
                    row = (key.as_py(), at // block, text[max(0, at - warm) : at], text[at : at + block])
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["key", "chunk", "before", "text"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _transducer(model_path)
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                entry, _ = counter.run(START, r["before"])
                found.append((r["key"], r["chunk"], json.dumps(entry), *counter.map(r["text"], entry)))
            columns = [pa.array([json.dumps(f[k]) if k == 3 else f[k] for f in found]) for k in range(5)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "chunk", "entry", "exit", "n"])

    chunks = texts.select("key", "text").mapInArrow(cut, "key string, chunk long, before string, text string")
    return chunks.repartition("key", "chunk").mapInArrow(mapped, "key string, chunk long, entry string, exit string, n long")


def long_counts(texts: DataFrame, model_path: str, block: int = BLOCK, warm: int = WARM) -> DataFrame:
    """(key, tokens) of distinct texts (key, text), from the maps of their chunks."""
    maps = written(chunk_maps(texts, model_path, block, warm), "token-maps")
    fits = (F.col("chunk") == 0) | (F.col("entry") == F.lag("exit").over(Window.partitionBy("key").orderBy("chunk")))
    sums = written(maps.select("key", "n", fits.alias("fits")).groupBy("key").agg(F.sum("n").alias("tokens"), F.bool_and("fits").alias("fits")), "token-sums")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _transducer(model_path)
        for batch in batches:
            found = [counter.count(t.as_py(), block) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.int64())], ["key", "tokens"])

    broken = narrow_side(sums.where("not fits").select("key"))
    rest = texts.join(broken, "key", "left_semi").select("key", "text").mapInArrow(chained, "key string, tokens long")
    return sums.where("fits").select("key", "tokens").unionByName(rest)


def _counted(docs: DataFrame, model_path: str, column: str, kept: list[str], block: int = BLOCK) -> DataFrame:
    """The ``kept`` columns of ``docs`` with the token count of ``text`` as ``column``."""
    key, short = "_token_key", "_token_short"
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(key, T.StringType()), T.StructField(short, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _transducer(model_path)
        for batch in batches:
            keys, counts = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                long = len(text) > block
                keys.append(hashlib.sha256(text.encode()).hexdigest() if long else None)
                counts.append(None if long else counter.count(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(keys, pa.string()), pa.array(counts, pa.int64())], [*kept, key, short])

    long = docs.where(F.length("text") > block).select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    counts = long_counts(written(long, "token-long"), model_path, block)
    sums = narrow_side(written(counts.select(F.col("key").alias("_token_text"), F.col("tokens").alias("_token_long")), "token-counts"))
    found = docs.mapInArrow(count, schema).join(sums, F.col(key) == F.col("_token_text"), "left")
    return found.select(*kept, F.coalesce("_token_long", short).alias(column))


def with_token_counts(docs: DataFrame, model_path: str, column: str = "n_tokens", block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``docs`` with the token count of ``text``, replacing a column of that name.

    A null or empty text has no tokens. ``model_path`` is opened on the executors, where the vocabulary is installed.
    Texts of more than ``block`` characters are counted in chunks.
    """
    return _counted(docs, model_path, column, [c for c in docs.columns if c != column], block)


def token_report(docs: DataFrame, model_path: str, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs``.

    A null or empty text has no bytes and no tokens; a null doc_id stays; repeated rows and equal texts get equal counts;
    very long texts are counted whole, in chunks; other columns go; an empty table gives an empty result.
    """
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = _counted(sized, model_path, "n_tokens", ["doc_id", "n_bytes"], block)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
