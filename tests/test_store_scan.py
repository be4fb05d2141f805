"""The laid out store: folders that filters leave out are not opened; ignore rules against a plain matcher."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sessionloom.sources import ignore, store
from sessionloom.sources.shared import new_path


def opened(df):
    """How many files a run of this plan, one without a shuffle, has opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().get("numFiles").get().value()


def test_folders_are_pruned(spark):
    root = new_path(spark, "store")
    rows = [(f"c{i}", f"org{i % 2}/repo{i % 3}" if i % 7 else "plain", f"2024-01-0{i % 4 + 1}", "notes", f"a{i % 2}", f"s{i}", f"text {i}") for i in range(120)]
    chunks = spark.createDataFrame(rows, "chunk_id string, project string, day string, kind string, agent string, session_id string, text string")
    store.lay_out(chunks, root)
    everything = store.scan(spark, root)
    assert sorted(tuple(r) for r in everything.select(*chunks.columns).collect()) == sorted(rows)
    files = opened(everything)
    for filters, holds in (
        ({"project": "org1/repo2"}, lambda r: r[1] == "org1/repo2"),
        ({"project": "ORG0/"}, lambda r: r[1].startswith("org0/")),
        ({"project": "plain"}, lambda r: r[1] == "plain"),
        ({"project": "absent"}, lambda r: False),
        ({"days": "2024-01-02..2024-01-03", "agent": "A1"}, lambda r: r[2] in ("2024-01-02", "2024-01-03") and r[4] == "a1"),
    ):
        found = store.scan(spark, root, **filters)
        want = [r for r in rows if holds(r)]
        assert sorted(r["chunk_id"] for r in found.collect()) == sorted(r[0] for r in want)
        leaves = len({(r[1], *r[2:5]) for r in want})
        assert opened(store.scan(spark, root, **filters)) == leaves < files
        assert "PartitionFilters: []" not in found._jdf.queryExecution().toString()


def plain_match(p, s):
    """Whether a pattern of pieces matches a text, by trying everything."""
    if not p:
        return not s
    if p.startswith("**/"):
        return any(plain_match(p[3:], s[k:]) for k in range(len(s) + 1) if k == 0 or s[k - 1] == "/")
    if p == "/**":
        return len(s) > 1 and s[0] == "/"
    if p.startswith("/**/"):
        return s[:1] == "/" and plain_match("**/" + p[4:], s[1:])
    if p[0] == "*":
        return any(plain_match(p[1:], s[k:]) for k in range(len(s) + 1))
    if p[0] == "{":
        end = p.index("}")
        return any(plain_match(x + p[end + 1 :], s) for x in p[1:end].split(","))
    if p[0] == "[":
        end = p.index("]", 2)
        body, no = (p[2:end], True) if p[1] == "!" else (p[1:end], False)
        return bool(s) and (bool(re.match(f"[{body}]", s[0])) != no) and plain_match(p[end + 1 :], s[1:])
    return bool(s) and (p[0] == "?" or p[0] == s[0]) and plain_match(p[1:], s[1:])


def test_patterns(spark):
    draw = random.Random(8)
    patterns = ["".join(draw.choice(["a", "b", "/", "*", "?", "[ab]", "[!a]", "{a,bb}", "/**/", ".md"]) for _ in range(draw.randint(1, 5))) for _ in range(150)]
    patterns = [p for p in patterns if "//" not in p and p[0] != "/" and p[-1] != "/" and "**" not in p.replace("/**/", "")] + ["**/b", "a/**", "a/**/b", "**"]
    paths = ["/".join(draw.choice(["a", "b", "ab", "bb.md", "c"]) for _ in range(draw.randint(1, 4))) for _ in range(60)]
    want = {(p, s): plain_match(p, s) if p != "**" else True for p in patterns for s in paths}
    assert {k: bool(re.match(ignore.pattern_regex(k[0]), k[1])) for k in want} == want
    table = spark.createDataFrame([(s,) for s in paths], "s string")
    rules = [(draw.random() < 0.4, p) for p in draw.sample(patterns, 25)]
    text = "\n".join(["# comment", "", *(("!" if back else "") + p for back, p in rules)])
    found = {r["s"]: r["i"] for r in table.select("s", ignore.ignored(F.col("s"), ignore.parse(text)).alias("i")).collect()}
    for s in paths:
        last = [back for back, p in rules if want[p, s]]
        assert found[s] == (bool(last) and not last[-1])


@pytest.mark.parametrize(("pattern", "path", "holds"), [("/org1/", "org1/a", True), ("/org1/", "org1", False), ("./a.md", "a.md", True), ("a\\*", "a*", True), ("a\\*", "ab", False), ("a//b", "a/b", True), ("a.md", "axmd", False)])
def test_heads_and_ends(pattern, path, holds):
    assert bool(re.match(ignore.pattern_regex(pattern), path)) == holds


def test_broken_patterns_and_none(spark):
    for bad in ("[a", "{a"):
        with pytest.raises(ValueError):
            ignore.parse(bad)
    assert spark.range(1).select(ignore.ignored(F.lit("a"), [])).first()[0] is False
