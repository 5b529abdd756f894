"""Secret scan with corpus-wide ownership frequency (operator 2), in DataFrame functions alone.

Spans come from regular expressions that run in the JVM: ``split`` gives the gaps between matches and
``regexp_extract_all`` the matches, so running sums of their lengths are the offsets in code points.
Every candidate value is hashed; the hashes are counted over the whole corpus by distinct owners and
distinct repositories. A value that many owners have in many repositories is a copied example; a value of one owner alone
that looks random is a live-looking credential. Base spans (assign, access, hex) always stay; vendor
tokens and long generic strings of letters and digits are added, the latter only where one owner alone has them.
``scan`` lists every such string; ``redact`` masks those that look random.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, col, cut, load, stored

# Patterns by kind, in the order of the output.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
VENDOR = r"gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----"
GENERIC = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}"
CHANGE = r"[a-z](?=[0-9A-Z])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])"
KINDS = ("assign", "access", "hex", "vendor", "generic")
BASE = 3
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|your[_-]|xxxx|0123456789|abcdef0123"

_ITEM = "struct<start:bigint,kind:int,end:bigint,value:string>"
_JUDGED = "array<struct<start:bigint,kind:int,end:bigint,owners:bigint,repos:bigint,live:boolean>>"


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def spans(text: Column, kind: int, pattern: str, group: int = 0, least: int = 0, chunk: int = 256) -> Column:
    """array<struct<start, kind, end, value>> of all leftmost non-overlapping matches, in code points.

    ``value`` is the group; matches whose value is shorter than ``least`` are dropped after matching. Sums run within
    chunks of matches and over the chunks, so the work follows the matches and not their square.
    """

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        value = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["hit"])).alias("end"), value.alias("value"))
        return F.struct((start + F.length(x["hit"])).alias("at"), F.when(F.length(value) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def within(c):
        return F.aggregate(c["pairs"], F.struct(c["at"].alias("at"), F.array().cast(f"array<{_ITEM}>").alias("out")), step, lambda acc: acc["out"])

    def placed(pairs):
        """Each chunk with the offset at which it begins."""
        of = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / chunk).cast("int")), lambda i: F.slice(pairs, i * chunk + 1, chunk))
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<at:bigint,pairs:array<struct<gap:string,hit:string>>>>").alias("out"))
        size = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"]))
        return F.aggregate(of, zero, lambda acc, c: F.struct((acc["at"] + size(c)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), c.alias("pairs")))).alias("out")), lambda acc: acc["out"])

    def paired(hits):
        return F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: _let(paired(hits), lambda pairs: F.flatten(F.transform(placed(pairs), within))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_ITEM}>"))


def live_looking(value: Column) -> Column:
    """Long enough, many distinct characters for its length, and not a placeholder."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 12) & (distinct >= F.least(F.lit(8), F.length(value))) & ~value.rlike(PLACEHOLDER)


def random_looking(value: Column) -> Column:
    """Live-looking, with a letter and a digit, and letters, digits and cases change once in six characters or more often.

    In a random string they change in every second or third character; in words, paths and file names at few places.
    """
    return live_looking(value) & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (6 * F.regexp_count(value, F.lit(CHANGE)) >= F.length(value))


def candidates(text: Column, random: bool = False) -> Column:
    """All spans of a text, base ones first; generic ones only where they touch no other span.

    A generic one has a letter and a digit; with ``random``, it must look random.
    """
    firm = [spans(text, 0, ASSIGN, 1, 8), spans(text, 1, ACCESS, 0, 16), spans(text, 2, HEX), spans(text, 3, VENDOR)]
    mixed = lambda v: v.rlike("[A-Za-z]") & v.rlike("[0-9]")
    loose = F.filter(spans(text, 4, GENERIC), lambda g: (random_looking if random else mixed)(g["value"]))
    return _let(reduce(F.concat, firm), lambda firm: F.concat(firm, F.filter(loose, lambda g: ~F.exists(firm, lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"])))))


def _found(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None, *more: Column, random: bool = False) -> DataFrame:
    """rid, id, owner, repo, more, and the candidates of every row, with hashes in the place of values."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    name = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    found = df.select(F.monotonically_increasing_id().alias("rid"), col(id_col).cast("long").alias("id"), name(owner_col).alias("owner"), (name(repo_col) if repo_col else F.lit("")).alias("repo"), *more, candidates(text, random).alias("found"))
    slim = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("h"), F.crc32(s["value"].cast("binary")).alias("c"), live_looking(s["value"]).alias("live")))
    return found.withColumn("found", slim)


def _each(found: DataFrame) -> DataFrame:
    """A row for each candidate."""
    return found.where(F.size("found") > 0).select("rid", "id", "owner", "repo", F.explode("found").alias("s")).select("rid", "id", "owner", "repo", "s.*")


def _frequency(each: DataFrame) -> DataFrame:
    """h, c, n (spans), owners and repos of every distinct value; a repository is told apart within its owner.

    Three steps, each partial on the map side, so a value in very many rows is a row per task and never a list.
    """
    by_repo = each.groupBy("h", "c", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("h", "c", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("h", "c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def _copied(owners: Column, repos: Column, copied_owners: int, copied_repos: int) -> Column:
    return (owners >= copied_owners) & (repos >= copied_repos)


def values(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "doc_id", copied_owners: int = 3, copied_repos: int = 3) -> DataFrame:
    """One row per distinct value of the spans of ``scan``: its hash, first kind, spans, owners, repos, live and verdict.

    ``repos`` counts its repositories of every owner. The verdict is copied, owned (one owner) or shared, as in ``scan``,
    whose edge cases hold here too.
    """
    each = _each(cut(_found(df, id_col, text_col, owner_col, repo_col)))
    one = each.groupBy("h", "c").agg(F.min("kind").alias("k"), F.count(F.lit(1)).alias("n_spans"), F.max("live").alias("live"))
    verdict = F.when(_copied(F.col("owners"), F.col("repos"), copied_owners, copied_repos), "copied").when(F.col("owners") == 1, "owned").otherwise("shared")
    kept = one.join(_frequency(each), ["h", "c"]).where("k < 4 or owners = 1")
    return kept.select(F.hex("h").alias("value_hash"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1).alias("kind"), "n_spans", "owners", "repos", "live", verdict.alias("verdict"))


def _judged(found: DataFrame, hot_share: int = 1000) -> DataFrame:
    """rid, id, all: the spans of rows that have candidates, sorted, with their values' owners and repositories.

    Generic spans stay only if one owner alone has the value. A value is hot if it is more than one in ``hot_share`` of all
    spans; there are fewer than ``hot_share`` such values, so their frequencies are broadcast, and no other
    value brings a large group to the join.
    """
    each = _each(found)
    frequency = cut(_frequency(each))
    total = frequency.agg(F.sum("n")).first()[0] or 0
    hot = frequency.where(F.col("n") > total // hot_share).select("h", "c", F.col("owners").alias("hot_owners"), F.col("repos").alias("hot_repos"))
    marked = each.drop("owner", "repo").join(F.broadcast(hot), ["h", "c"], "left")
    often = marked.where("hot_owners is not null").withColumnsRenamed({"hot_owners": "owners", "hot_repos": "repos"})
    rare = marked.where("hot_owners is null").drop("hot_owners", "hot_repos").join(frequency.where(F.col("n") <= total // hot_share).drop("n"), ["h", "c"])
    judged = often.unionByName(rare)
    per_row = judged.groupBy("rid", "id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", "live"))).alias("all"))
    return per_row.withColumn("all", F.filter("all", lambda s: (s["kind"] < 4) | (s["owners"] == 1)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "doc_id", copied_owners: int = 3, copied_repos: int = 3) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, and counts by verdict.

    ``spans`` holds kind:start:end by start, then kind; ``base_sha256`` digests the base ones. Verdicts: ``n_copied``
    values have at least ``copied_owners`` owners and ``copied_repos`` repositories, ``n_owned`` have one owner, ``n_live`` of
    these look random, ``n_single`` occur in one repository alone; ``most_repos`` is the largest number of
    repositories of a value (0 without spans). A repository is a value of ``repo_col`` within an owner (None: each owner
    is one).

    Null and empty texts have no spans; null owners or repositories count as one nameless owner or repository; texts of any
    length are read whole; repeated rows and ids stay apart, and equal starts are ordered by kind; extra columns are
    ignored, whatever their names; an empty table gives an empty table.
    """
    found = cut(_found(df, id_col, text_col, owner_col, repo_col))
    names = F.array(*map(F.lit, KINDS))
    write = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda cond: F.size(F.filter("all", cond)).cast("long")

    def of_kind(k: int) -> Column:
        return count(lambda s: s["kind"] == k)

    def result(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("id").alias(id_col),
            *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
            F.sha2(write(F.filter("all", lambda s: s["kind"] < BASE)).cast("binary"), 256).alias("base_sha256"),
            write("all").alias("spans"),
            F.size("all").cast("long").alias("n_spans"),
            count(lambda s: _copied(s["owners"], s["repos"], copied_owners, copied_repos)).alias("n_copied"),
            count(lambda s: s["owners"] == 1).alias("n_owned"),
            count(lambda s: (s["owners"] == 1) & s["live"]).alias("n_live"),
            count(lambda s: s["repos"] == 1).alias("n_single"),
            F.coalesce(F.array_max(F.transform("all", lambda s: s["repos"])), F.lit(0)).cast("long").alias("most_repos"),
        )

    empty = found.where(F.size("found") == 0).select("id", F.array().cast(_JUDGED).alias("all"))
    return result(_judged(found).select("id", "all").unionByName(empty))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "doc_id", mask: str = "[secret]", copied_mask: str = "[copied]", copied_owners: int = 3, copied_repos: int = 3) -> DataFrame:
    """The rows with every span of ``scan`` replaced by a mask in the text (overlapping spans by one), but of the generic ones
    only those that look random.

    The verdict decides which: ``copied_mask`` where all overlapping values are copied and don't look live, so they are
    examples; else ``mask``. Rows are written once, numbered and with their spans, and both those without and those
    with spans are read from there; only the latter meet the frequencies in a join.

    Columns stay as they are named and ordered, whatever their names; a null text stays null and an empty one empty; texts of any
    length are read whole; repeated rows are masked alike and stay apart; an empty table stays empty.
    """
    others = [c for c in df.columns if c != text_col]
    rows = stored(_found(df, id_col, text_col, owner_col, repo_col, col(text_col).cast("string").alias("text"), boxed(df, others).alias("box"), random=True))
    spans = _judged(rows.select("rid", "id", "owner", "repo", "found")).select("rid", "all")
    text = F.col("text")

    def shown(tag: Column) -> Column:
        return F.when(tag, copied_mask).when(~tag, mask).otherwise("")

    def step(acc, s):
        """``tag``: whether the spans since ``out`` ended are all copied; null before the first."""
        copied, apart = _copied(s["owners"], s["repos"], copied_owners, copied_repos) & ~s["live"], s["start"] >= acc["at"]
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int"))
        out = F.when(apart, F.concat(acc["out"], shown(acc["tag"]), gap)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"), F.when(apart, copied).otherwise(acc["tag"] & copied).alias("tag"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"), F.lit(None).cast("boolean").alias("tag"))
    done = F.aggregate("all", zero, step, lambda acc: F.concat(acc["out"], shown(acc["tag"]), F.substr(text, (acc["at"] + 1).cast("int"))))
    places = {c: F.col(f"box.c{i}") for i, c in enumerate(others)}

    def result(rows: DataFrame, new: Column) -> DataFrame:
        return rows.select(*[new.cast(df.schema[text_col].dataType).alias(c) if c == text_col else places[c].alias(c) for c in df.columns])

    touched = rows.where(F.size("found") > 0).select("rid", "text", "box").join(spans, "rid")
    return result(rows.where(F.size("found") == 0), text).unionByName(result(touched, F.when(F.size("all") > 0, done).otherwise(text)))


def query(spark, sf_dir: str) -> DataFrame:
    """Owners are the sources; the documents of one language of a source count as one repository."""
    return scan(load(spark, sf_dir, "documents"), repo_col="lang", copied_repos=4)
