"""Operator 10 (built-in functions only): secrets by rules and corpus-wide ownership frequency.

Rules find assignments, access keys and long hex runs in whole texts with
their places in code points.  Besides their values, every long token that
mixes upper case, lower case and digits is a candidate credential.  The
hashes of all candidates are counted over the corpus by distinct repositories
and owners.  A value of ``example_owners`` owners or more, or of
``example_repos`` repositories or more, is a copied example; any other looks
live, and its place becomes a span of kind ``live``.

Counting goes (value, owner, repository) -> (value, owner) -> value, each step
aggregated inside the tasks before its shuffle, so a value that a third of all
rows carry is no hot key.  Values on more than a thousandth of all candidate
rows (fewer than a thousand values) are joined back by broadcast, all others
by a shuffle.

Cases: null is the empty text; null owners and repositories count as one
owner or repository of their own; repeated rows and doc_ids get a result each;
extra columns are not read.  The work in one
text grows with its length and matches, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"  # maximal runs, so shorter ones need not be matched and dropped
MIXED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
MIN_VALUE, MIN_ACCESS = 6, 20
KINDS = ["assign", "access", "hex", "live"]
_FOUND = ["assign", "access", "hex", "mixed"]
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 4
BLOCK = 256
HEAVY_SHARE = 1000


def _pieces(text: Column, pattern: str, maybe: Column, value_group: int = 0) -> Column:
    """array<struct<gap, len, v>> of all leftmost matches: the code points before each since the last, and its own."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("v"),
                         F.split(text, F.lit(pattern), -1).alias("gap"))  # one piece more than matches
    found = F.transform(F.filter(found, lambda x: x["m"].isNotNull()), lambda x: F.struct(
        F.char_length(x["gap"]).alias("gap"), F.char_length(x["m"]).alias("len"), x["v"].alias("v")))
    return F.when(maybe, found).otherwise(F.array().cast("array<struct<gap:int,len:int,v:string>>"))


def _blocks(pieces: Column) -> Column:
    """The pieces in blocks of ``BLOCK``: a fold copies its array at each step, so it runs over one block at a time."""
    n = F.size(pieces)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")))
    return F.coalesce(F.transform(starts, lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))),
                      F.array().cast("array<array<struct<gap:int,len:int,v:string>>>"))


def _placed(blocks: Column) -> Column:
    """array<struct<s, e, v>>: the places of all matches, from the lengths of the pieces."""
    lengths = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, p: a + p["gap"] + p["len"]))
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["gap"]
        return F.struct((s + x["len"]).alias("at"), F.concat(a["out"], F.array(F.struct(
            s.alias("s"), (s + x["len"]).alias("e"), x["v"].alias("v")))).alias("out"))

    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    each = F.transform(F.arrays_zip(blocks.alias("block"), F.slice(starts, F.lit(1), F.size(blocks)).alias("at")), lambda x: F.aggregate(
        x["block"], F.struct(x["at"].alias("at"), none.alias("out")), step, lambda a: a["out"]))
    return F.flatten(each)


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: list[str]) -> DataFrame:
    """doc_id, owner, repo, the base spans by kind, and cand (array of place and value hash)."""
    rows = only(docs, doc_id=id_col, text=text_col, owner=owner_col, **{f"r{i}": c for i, c in enumerate(repo_cols)})
    text = F.col("text")
    rows = rows.select("doc_id", F.xxhash64("owner").alias("owner"),
                       F.xxhash64("owner", *[f"r{i}" for i in range(len(repo_cols))]).alias("repo"),
                       F.coalesce("text", F.lit("")).alias("text"))
    # each step uses the columns of the one before more than once, so they stay columns and are computed once
    rows = rows.withColumns({"assign": _pieces(text, ASSIGN, text.contains("=") | text.contains(":"), 2),
                             "access": _pieces(text, ACCESS, text.contains("AKIA")),
                             "hex": _pieces(text, HEX, text.rlike(HEX)),
                             "mixed": _pieces(text, MIXED, text.rlike(MIXED))})
    rows = rows.withColumns({c: _blocks(F.col(c)) for c in _FOUND})
    rows = rows.withColumns({c: _placed(F.col(c)) for c in _FOUND})
    rows = (rows
                .withColumn("assign", F.filter("assign", lambda x: F.char_length(x["v"]) >= MIN_VALUE))
                .withColumn("access", F.filter("access", lambda x: x["e"] - x["s"] >= MIN_ACCESS))
                .withColumn("mixed", F.filter("mixed", lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[a-z]")
                                              & x["v"].rlike("[A-Z]"))))
    every = F.concat("assign", "access", "hex", "mixed")
    place = lambda name: F.transform(name, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(name)
    rows = rows.withColumn("cand", F.sort_array(F.transform(every, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.xxhash64(x["v"]).alias("h")))))
    # sorted, equal ones are neighbours: array_distinct would compare all structs with each other
    once = F.filter("cand", lambda x, i: ~x.eqNullSafe(F.get("cand", i - 1)))
    return rows.select("doc_id", "owner", "repo", place("assign"), place("access"), place("hex"), once.alias("cand"))


def ownership(cand: DataFrame) -> DataFrame:
    """h, n_owners, n_repos, n_rows of every candidate value (cand: h, owner, repo, one row per place)."""
    return (cand.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
            .groupBy("h", "owner").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n"))
            .groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos"),
                              F.sum("n").alias("n_rows")))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, then end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _tagged(name: str, kind: str) -> Column:
    return F.transform(name, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"),
                                                x["e"].alias("e")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_cols: tuple[str, ...] = ("lang",), example_owners: int = EXAMPLE_OWNERS,
                 example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, and ownership: both counts by place.

    ``repo_cols`` name, together with the owner, a repository."""
    base = materialize(candidates(docs, id_col, text_col, owner_col, list(repo_cols))
                       .withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    cand = base.select("row", "owner", "repo", F.inline("cand"))
    counts = materialize(ownership(cand), "secret-ownership")
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    least_heavy = total // HEAVY_SHARE + 1
    verdict = counts.select("h", "n_owners", "n_repos", "n_rows")
    heavy = verdict.where(F.col("n_rows") >= least_heavy).drop("n_rows")  # fewer than HEAVY_SHARE values
    heavy = heavy.withColumnsRenamed({"n_owners": "heavy_owners", "n_repos": "heavy_repos"})
    marked = cand.select("row", "s", "e", "h").join(F.broadcast(heavy), "h", "left")
    rest = marked.where("heavy_owners is null").drop("heavy_owners", "heavy_repos").join(
        verdict.where(F.col("n_rows") < least_heavy).drop("n_rows"), "h")
    known = marked.where("heavy_owners is not null").withColumnsRenamed({"heavy_owners": "n_owners", "heavy_repos": "n_repos"})
    columns = ["row", "s", "e", "n_owners", "n_repos"]
    judged = rest.select(columns).unionByName(known.select(columns)).withColumn(
        "live", (F.col("n_owners") < example_owners) & (F.col("n_repos") < example_repos))
    spot = F.struct(F.col("s"), F.lit(KINDS.index("live")).alias("k"), F.col("e"))
    found = judged.groupBy("row").agg(F.collect_set(F.when(F.col("live"), spot)).alias("live"),
                                      F.count_if(~F.col("live")).alias("n_example"),
                                      F.array_sort(F.collect_set(F.struct("s", "e", "n_owners", "n_repos"))).alias("ownership"))
    out = base.drop("cand", "owner", "repo").join(found, "row", "left")
    own = F.concat(_tagged("assign", "assign"), _tagged("access", "access"), _tagged("hex", "hex"))
    live = F.coalesce("live", F.array().cast("array<struct<s:int,k:int,e:int>>"))
    size = lambda c: F.size(c).cast("long")
    return out.select(F.col("doc_id").alias(id_col), size("assign").alias("n_assign"), size("access").alias("n_access"),
                      size("hex").alias("n_hex"), F.sha2(_listed(own), 256).alias("base_sha256"),
                      _listed(F.concat(own, live)).alias("spans"), size(live).alias("n_live"),
                      F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
                      F.coalesce("ownership", F.array().cast("array<struct<s:int,e:int,n_owners:long,n_repos:long>>")).alias("ownership"))
