"""Which repository a row belongs to, and how far that can be trusted: primary, secondary or fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import trimmed

# Names that are folders of any project, hosts, and folders below which organisations lie.
RESERVED = (".", "..", "...", "local", "tmp", "temp", "src", "app", "lib", "docs", "workspace", "workspaces")
REMOTE = r"^(?:https?://(?:github|gitlab)\.com/|git@(?:github|gitlab)\.com:)([^/\s]*)/([^/\s]*)"
LAYOUTS = ("hosted", "repos", "repositories", "github", "git")
DATE_LIKE = r"^(\d{4}-\d\d-\d\d|\d{4}_\d\d_\d\d|\d{4}_\d{4})$"


def plausible(name: Column) -> Column:
    """Whether a name may be that of a repository: at most 64 of letters, digits, dots, dashes, no reserved word, no date."""
    dots = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    shaped = name.rlike(r"^[0-9A-Za-z][0-9A-Za-z._-]{0,63}$")
    return F.coalesce(shaped & ~F.lower(name).isin(*RESERVED) & (dots <= F.floor(F.length(name) / 2)) & ~name.rlike(DATE_LIKE), F.lit(False))


def weak(x: Column) -> Column:
    """At least 16 hex digits and nothing else: a name that says nothing by itself."""
    return x.rlike(r"^[0-9A-Fa-f]{16,}$")


def from_remote(text: Column) -> Column:
    """org/repo of the first word that is the address of a hosted repository, else null."""
    word = lambda w: F.regexp_replace(w, r"""^["',.)(\[\]]+|["',.)(\[\]]+$""", "")
    found = F.get(F.filter(F.transform(F.split(text, r"\s+"), word), lambda w: w.rlike(REMOTE)), 0)
    org, repo = F.regexp_extract(found, REMOTE, 1), F.regexp_replace(F.regexp_extract(found, REMOTE, 2), r"(\.git)+$", "")
    named = F.when(plausible(org) & plausible(repo), F.concat(org, F.lit("/"), repo)).otherwise(F.concat(F.lit("local/"), F.when(plausible(repo), repo).otherwise("unknown")))
    return F.when(found.isNotNull(), named)


def from_layout(path: Column) -> Column:
    """org/repo of a path with a known folder above them; the folders count in the order of LAYOUTS."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    low = F.transform(parts, F.lower)
    found = None
    for marker in LAYOUTS:
        at = F.array_position(low, marker).cast("int")
        org, repo = F.get(parts, at), F.get(parts, at + 1)
        fits = (at > 0) & plausible(org) & plausible(repo)
        found = F.when(fits, F.concat(org, F.lit("/"), repo)) if found is None else found.when(fits, F.concat(org, F.lit("/"), repo))
    return found


def resolved(rows: DataFrame, git_roots: DataFrame, registry: DataFrame) -> DataFrame:
    """``rows`` (with ``cwd`` and ``message``) with ``bucket``, ``tier`` and ``via``.

    ``git_roots`` lists (root, remote), a remote may be null; ``registry`` lists (hash, slug). An address as cwd is
    primary, as is the nearest root above it with a remote; a root by its layout or name is secondary, a layout alone
    fallback. A hash goes through the registry. A text that names an address gives a bucket but no tier. The ancestors of
    a cwd are exploded, so the roots are found by an equi-join, over distinct cwds.
    """
    cwds = rows.select("cwd").where("cwd is not null").distinct().withColumn("_p", trimmed(F.col("cwd")))
    parts = F.split("_p", "/")
    above = cwds.select("cwd", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "root"))
    nearest = above.join(git_roots, "root").groupBy("cwd").agg(F.max_by(F.struct("root", "remote"), "depth").alias("g"))
    hashes = registry.select(F.col("hash").alias("_p"), F.col("slug").alias("_slug"))
    known = cwds.join(nearest, "cwd", "left").join(hashes, "_p", "left")
    has = (F.col("_p") != "") & ~weak(F.col("_p"))
    remote, of_root, by_layout, below = from_remote(F.col("_p")), from_remote(F.col("g.remote")), from_layout(F.col("g.root")), from_layout(F.col("_p"))
    basename = F.concat(F.lit("local/"), F.substring_index(F.col("g.root"), "/", -1))
    named = lambda slug, tier, via: F.struct(slug.alias("bucket"), F.lit(tier).alias("tier"), F.lit(via).alias("via"))
    found = (
        F.when(has & remote.isNotNull(), named(remote, "primary", "remote"))
        .when(has & of_root.isNotNull(), named(of_root, "primary", "remote"))
        .when(has & by_layout.isNotNull(), named(by_layout, "secondary", "root"))
        .when(has & F.col("g.root").isNotNull(), named(basename, "secondary", "root"))
        .when(has & below.isNotNull(), named(below, "fallback", "layout"))
        .when(weak(F.col("_p")) & F.col("_slug").isNotNull(), named(F.col("_slug"), "secondary", "layout"))
    )
    by_cwd = known.select(F.col("cwd").alias("_cwd"), found.alias("_found"))
    out = rows.join(by_cwd, rows["cwd"] == by_cwd["_cwd"], "left")
    said = from_remote(F.col("message"))
    none = F.when(said.isNotNull(), F.struct(said.alias("bucket"), F.lit(None).cast("string").alias("tier"), F.lit("mention").alias("via")))
    last = F.struct(F.lit("unclassified").alias("bucket"), F.lit(None).cast("string").alias("tier"), F.lit("none").alias("via"))
    return out.withColumn("_found", F.coalesce("_found", none, last)).select(*(rows[c] for c in rows.columns), "_found.*")
