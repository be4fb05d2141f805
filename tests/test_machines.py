"""State machines over lines against a walk from line to line."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import machines


@pytest.mark.parametrize(("block", "seed"), [(1, 0), (3, 1), (64, 2)])
def test_states(spark, block, seed):
    draw = random.Random(seed)
    machine = machines.Machine.built(5, 3, lambda s, x: draw.randrange(5))
    texts = {t: [draw.randrange(3) for _ in range(draw.choice([1, 2, 9, 40]))] for t in range(12)}
    texts[None] = [1, 0, 2, 2]
    lines = spark.createDataFrame([(t, i, x) for t, xs in texts.items() for i, x in enumerate(xs)], "text_id long, line_no long, symbol int").repartition(3)
    want = set()
    for t, xs in texts.items():
        state = 0
        for i, x in enumerate(xs):
            want.add((t, i, x, state))
            state = machine.table[state * 3 + x]
    assert {tuple(r) for r in machines.entered(lines, machine, block).collect()} == want
    assert machines.entered(lines.where("false"), machine, block).count() == 0


def walk(rows):
    """noise, signal, header, footer, exit and line of each line of one text: the class of each."""
    inside = code = False
    run, out = 0, []
    for noise, signal, header, footer, leaves, line in rows:
        line = line.strip()
        if not line:
            out.append(None)
            continue
        if line.startswith("```"):
            code = not code
            if inside:
                run += 1
                out.append("noise")
                continue
        if code and inside:
            run += 1
            out.append("noise")
            continue
        found = "noise" if noise else "signal" if signal else "noise" if inside or header or footer else "neutral"
        if not inside and header:
            inside = True
        if inside and leaves:
            inside = False
        run = run + 1 if found == "noise" else 0
        if run > machines.RUN and not inside:
            inside = True
        out.append(found)
    return out


@pytest.mark.parametrize("block", [2, 50])
def test_boilerplate(spark, block):
    draw = random.Random(block)
    flag = lambda p: draw.random() < p
    texts = {t: [(flag(p), flag(0.2), flag(0.08), flag(0.1), flag(0.1), draw.choice(["", "x", "```", "y", "z"])) for _ in range(draw.choice([3, 30, 70]))] for t, p in enumerate([0.1, 0.5, 0.95] * 8)}
    lines = spark.createDataFrame([(t, i, *x) for t, xs in texts.items() for i, x in enumerate(xs)], "text_id long, line_no long, noise boolean, signal boolean, header boolean, footer boolean, exit boolean, line string")
    found = {(r["text_id"], r["line_no"]): r["class"] for r in machines.line_classes(lines, block).collect()}
    assert found == {(t, i): c for t, xs in texts.items() for i, c in enumerate(walk(xs))}


def test_voice_and_blocks(spark):
    draw = random.Random(4)
    pieces = ["<voice id=1>", "</voice>", "a", " b ", "<b>", "[[", "]]"]
    texts = {t: ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 3))) for _ in range(25)] for t in range(8)}
    lines = spark.createDataFrame([(t, i, x) for t, xs in texts.items() for i, x in enumerate(xs)], "text_id long, line_no long, line string")
    spoken, kept = {}, set()
    for t, xs in texts.items():
        on = inside = False
        for i, x in enumerate(xs):
            said = on
            for tag in re.findall("<voice[^>]*>|</voice>", x):
                on = tag[1] != "/"
                said |= on
            spoken[t, i] = (re.sub("<voice[^>]*>|</voice>", "", x).strip(), said)
            if "[[" in x:
                inside = True
            elif "]]" in x:
                inside = False
            elif not inside:
                kept.add((t, i, x))
    assert {(r["text_id"], r["line_no"]): (r["line"], r["spoken"]) for r in machines.voice_lines(lines, block=4).collect()} == spoken
    assert {tuple(r) for r in machines.outside_blocks(lines, "[[", "]]", 4).select("text_id", "line_no", "line").collect()} == kept
