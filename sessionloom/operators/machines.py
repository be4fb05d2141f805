"""State machines over the lines of texts, by a scan in which one long text is many tasks.

What a line does to the state is a symbol, and a symbol is a map of states. The lines of a text are cut into blocks; the
map of a block is the composition of its lines' maps, and the state in which each block is entered comes from a parallel
prefix composition over the blocks: in turn k each block takes in the map of the block 2^k before it. Then each block runs
by itself from its own state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import trimmed
from sessionloom.sources.shared import written

#: Lines of a block.
BLOCK = 256
#: Lines of noise after which all is boilerplate.
RUN = 10


@dataclass(frozen=True)
class Machine:
    """``table[state * symbols + symbol]`` is the next state; state 0 is where a text begins."""

    states: int
    symbols: int
    table: tuple[int, ...]

    @classmethod
    def built(cls, states: int, symbols: int, step: Callable[[int, int], int]) -> Machine:
        return cls(states, symbols, tuple(step(s, x) for s in range(states) for x in range(symbols)))

    def next(self, state: Column, symbol: Column) -> Column:
        return F.get(F.lit(list(self.table)), (state * self.symbols + symbol).cast("int"))


def entered(lines: DataFrame, machine: Machine, block: int = BLOCK) -> DataFrame:
    """``lines`` (text_id, line_no from 0, symbol, and more) with ``state``, in which each line is entered.

    Texts are told apart by text_id; a null one is a text of its own; line numbers of a text are distinct and may have gaps.
    """
    rest = [c for c in lines.columns if c not in ("text_id", "line_no", "symbol")]
    rows = lines.select("text_id", F.floor(F.col("line_no") / block).cast("long").alias("b"), F.struct("line_no", "symbol", *rest).alias("x"))
    blocks = rows.groupBy("text_id", "b").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # at most ``block`` lines
    run = lambda start: F.aggregate("xs", start, lambda s, x: machine.next(s, x["symbol"]))
    maps = F.transform(F.sequence(F.lit(0), F.lit(machine.states - 1)), lambda s: run(s))
    blocks = written(blocks.withColumn("map", maps), "line-blocks")
    prefix = blocks.select("text_id", "b", "map")
    last, step = blocks.agg(F.max("b")).first()[0] or 0, 1
    while step <= last:
        before = prefix.select(F.col("text_id").alias("_t"), (F.col("b") + step).alias("_b"), F.col("map").alias("_map"))
        met = prefix.join(before, F.col("text_id").eqNullSafe(F.col("_t")) & (F.col("b") == F.col("_b")), "left")
        both = F.when(F.col("_map").isNull(), F.col("map")).otherwise(F.transform("_map", lambda s: F.get("map", s)))
        prefix, step = written(met.select("text_id", "b", both.alias("map")), "line-maps"), step * 2
    before = prefix.select(F.col("text_id").alias("_t"), (F.col("b") + 1).alias("_b"), F.get("map", 0).alias("_start"))
    met = blocks.join(before, F.col("text_id").eqNullSafe(F.col("_t")) & (F.col("b") == F.col("_b")), "left")
    none = F.array().cast("array<int>")
    states = F.aggregate("xs", F.struct(F.coalesce("_start", F.lit(0)).alias("s"), none.alias("out")), lambda a, x: F.struct(machine.next(a["s"], x["symbol"]).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))["out"]
    each = met.select("text_id", F.explode(F.arrays_zip(F.col("xs").alias("x"), states.alias("state"))).alias("e"))
    return each.select("text_id", "e.x.*", "e.state")


def voice_lines(lines: DataFrame, tag: str = "voice", block: int = BLOCK) -> DataFrame:
    """text_id, line_no, the line without its tags, and whether it is spoken: inside <tag ...> and </tag>, or with one begun in it."""
    opens, closes = rf"<\s*{tag}[^>]*>", rf"<\s*/{tag}\s*>"
    every = F.regexp_extract_all("line", F.lit(f"({opens}|{closes})"), F.lit(1))
    last = F.element_at(every, -1)
    symbol = F.when(F.size(every) == 0, 0).when(last.rlike(r"^<\s*/"), 2).otherwise(1)
    machine = Machine.built(2, 3, lambda s, x: (s, 1, 0)[x])
    found = entered(lines.withColumns({"symbol": symbol, "begun": F.col("line").rlike(opens)}), machine, block)
    return found.select("text_id", "line_no", trimmed(F.regexp_replace("line", f"{opens}|{closes}", "")).alias("line"), ((F.col("state") == 1) | F.col("begun")).alias("spoken"))


def outside_blocks(lines: DataFrame, begin: str, end: str, block: int = BLOCK) -> DataFrame:
    """The lines that stand in no block between a line with ``begin`` and one with ``end``; both of these go too."""
    symbol = F.when(F.contains("line", F.lit(begin)), 1).when(F.contains("line", F.lit(end)), 2).otherwise(0)
    found = entered(lines.withColumn("symbol", symbol), Machine.built(2, 3, lambda s, x: (s, 1, 0)[x]), block)
    return found.where("state = 0 and symbol = 0").drop("symbol", "state")


#: Classes of a line.
NOISE, SIGNAL, FOOTER, OTHER = range(4)


def _boilerplate(state: int, symbol: int) -> tuple[int, str | None]:
    """The next state and the class of a line. States: inside boilerplate, inside a code block, lines of noise in a row."""
    inside, code, run = state // (2 * (RUN + 2)), state // (RUN + 2) % 2, state % (RUN + 2)
    if symbol == 32:  # an empty line
        return state, None
    kind, exits, header, fence = symbol % 4, symbol // 4 % 2, symbol // 8 % 2, symbol // 16
    pack = lambda i, c, n: (i * 2 + c) * (RUN + 2) + min(n, RUN + 1)
    code ^= fence
    if inside and (fence or code):
        return pack(inside, code, run + 1), "noise"
    found = "noise" if kind == NOISE else "signal" if kind == SIGNAL else "noise" if inside or header or kind == FOOTER else "neutral"
    inside = 0 if exits and (inside or header) else 1 if header else inside
    run = run + 1 if found == "noise" else 0
    return pack(1 if run > RUN else inside, code, run), found


BOILERPLATE = Machine.built(4 * (RUN + 2), 33, lambda s, x: _boilerplate(s, x)[0])
_CLASSES = [_boilerplate(s, x)[1] for s in range(BOILERPLATE.states) for x in range(33)]


def line_classes(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """text_id, line_no and class (signal, noise, neutral; null for an empty line) of lines with noise, signal, header, footer, exit.

    A header begins boilerplate, in which all is noise but signals; so do more than RUN lines of noise in a row. What
    exits, such as a turn of a conversation, ends it. A code block within it is noise whatever it holds.
    """
    line = trimmed(F.col("line"))
    kind = F.when(F.col("noise"), NOISE).when(F.col("signal"), SIGNAL).when(F.col("footer"), FOOTER).otherwise(OTHER)
    flags = F.col("exit").cast("int") * 4 + F.col("header").cast("int") * 8 + F.startswith(line, F.lit("```")).cast("int") * 16
    symbol = F.when(line == "", 32).otherwise(kind + flags)
    found = entered(lines.select("text_id", "line_no", symbol.alias("symbol")), BOILERPLATE, block)
    return found.select("text_id", "line_no", F.get(F.lit([c or "" for c in _CLASSES]), (F.col("state") * 33 + F.col("symbol")).cast("int")).alias("class")).withColumn("class", F.nullif("class", F.lit("")))
