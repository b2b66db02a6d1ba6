"""Secret scans with corpus-wide ownership frequency, with Spark's own functions only.

Each regex's matches come from regexp_extract_all, their places from the lengths of the pieces
between them (split by the same regex). Candidate values are hashed; per hash the corpus counts
distinct owners and repositories. A value that several owners have, or one owner in many repositories, is a
copied example; a rarer one that looks random is reported as live. A word of documentation in the value is a hint
only: it lowers the number of repositories that make an example.

Kinds assign, access and hex follow fixed rules (leftmost, non-overlapping per kind, failing matches
dropped without a retry). The method adds jwt, github and pem spans; pem is the whole key block, to its
END line or, without one, as far as lines of base64 go. Each regex but that of hex runs only on texts that
contain a literal which all its matches contain.

Defined cases: null and empty texts have no spans; a null owner counts as one owner of its own; ids
may be null or repeated (rows are joined by a key of their content); an empty table gives no rows; other
columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.skew import split_join
from tessella.llm.storage import written

#: Matches whose places are gathered at once.
PART = 128
_PEM = r"[A-Za-z0-9+/=:,.\s]"
#: kind, regex, group with the secret value, least length of that value. Loops that can't give anything back are possessive
#: (a possessive group is repeated without recursion), and a jwt's header has a bound, so that each rule takes linear time.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{1,512}+\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+", 0, 30),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("pem", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_PEM}*+(?:-{_PEM}++)*+-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\r\n]*)", 0, 20),
)
#: Literals of which each match has one (assign: in lower case).
LITERALS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("AKIA",),
    "jwt": ("eyJ",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "pem": ("-----BEGIN ",),
}
KINDS = tuple(r[0] for r in RULES)
BASE = KINDS[:3]
#: A password is live from this length on, as people choose it; other values look random from LONG on.
SHORT, LONG = 6, 12
PASSWORD = r"(?i)^passw"
#: Repositories of one owner that make a value an example, and as many if it has a word of documentation.
REPOSITORIES, HINTED = 10, 2
#: Words of documentation.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000"


def _scanned(kind: str, regex: str, least: int) -> str:
    """hex runs too short to count can be left unmatched: a longer run never begins inside one."""
    return regex[:-1] + "{%d,}" % least if kind == "hex" else regex


def in_parts(items: Column, size: int = PART) -> Column:
    """An array as arrays of a few items: a list that grows by one item is copied each time, so that only short ones may."""
    cut = lambda all: F.transform(F.sequence(F.lit(0), F.greatest(F.size(all) - 1, F.lit(0)), F.lit(size)), lambda at: F.slice(all, at + 1, size))
    return F.transform(F.array(items), cut)[0]  # a variable's value is computed once, an expression's for each part


def _matches(rank: int, kind: str, regex: str, group: int, least: int) -> Column:
    """Array of (start, rank, end, kind, value, password) of one rule over the columns text and low (in lower case)."""
    regex = _scanned(kind, regex, least)
    text, pattern = F.col("text"), F.lit(regex)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(group)) if group else whole
    found = F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, regex, -1).alias("gap"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,password:boolean>>")
    moved = lambda s, by: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), s["password"].alias("password"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        password = F.coalesce(x["m"].rlike(PASSWORD), F.lit(False)) if kind == "assign" else F.lit(False)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"), password.alias("password"))
        keep = F.coalesce(F.length(x["v"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def add(acc: Column, some: Column) -> Column:
        own = F.aggregate(some, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)
        return F.struct((acc["at"] + own["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(own["out"], lambda s: moved(s, acc["at"])))).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array(empty).alias("out"))
    spans = F.aggregate(in_parts(found), begin, add, lambda acc: F.flatten(acc["out"]))
    likely = text.rlike(regex)
    if kind in LITERALS:
        likely = reduce(lambda a, b: a | b, (F.col("low" if kind == "assign" else "text").contains(x) for x in LITERALS[kind])) & likely
    return F.when(likely, spans).otherwise(empty)


def _row_key(id_col: str, text_col: str, owner_col: str) -> Column:
    """Rows with equal ids, owners and texts have equal spans."""
    return F.sha2(F.to_json(F.struct(F.col(id_col).cast("string").alias("a"), F.col(owner_col).cast("string").alias("b"), F.coalesce(F.col(text_col), F.lit("")).alias("c"))), 256)


def spans_of(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with the column name: spans (start, rank, end, kind, value, password) by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.lower(text).alias("low"))
    spans = F.array_sort(F.concat(*(_matches(i, *rule) for i, rule in enumerate(RULES))))
    return whole.select("row.*", spans.alias(name))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """Per row: id, key, owner, repo and spans."""
    own = docs.select(F.col(id_col).alias("id"), *_names(id_col, text_col, owner_col, repo_col), F.col(text_col).alias("text"))
    return spans_of(own, "text", "spans").drop("text")


def _names(id_col: str, text_col: str, owner_col: str, repo_col: str | None) -> list[Column]:
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00"))
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit("\x00")) if repo_col else owner
    return [_row_key(id_col, text_col, owner_col).alias("key"), owner.alias("owner"), repo.alias("repo")]


def judged(found: DataFrame, common_owners: int, common_repositories: int) -> DataFrame:
    """Per key of candidates() with spans: the spans with owners, repositories and a verdict."""
    each = found.where("size(spans) > 0").select("key", "owner", "repo", F.explode("spans").alias("s"))
    each = each.withColumn("hash", F.sha2("s.value", 256))
    # Two steps, so that one very common value is first reduced to a row for each owner and repository.
    each = each.dropDuplicates(["key", "s"])
    stats = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.sum("n").alias("n"), F.count_distinct("owner").cast("long").alias("owners"), F.count_distinct("repo").cast("long").alias("repositories"))
    value = F.col("s.value")
    random = (F.length(value) >= F.when(F.col("s.password"), SHORT).otherwise(LONG)) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    common = F.col("repositories") >= F.when(value.rlike(PLACEHOLDER), F.least(F.lit(HINTED), F.lit(common_repositories))).otherwise(common_repositories)
    verdict = F.when((F.col("owners") >= common_owners) | common, "example").when(random | F.col("s.kind").isin("pem", "github", "jwt"), "live").otherwise("weak")
    span = F.struct(F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), value.alias("value"), F.col("owners"), F.col("repositories"), verdict.alias("verdict"))
    return split_join(each, stats, "hash", "n", "key").groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, common_owners: int = 2, common_repositories: int = REPOSITORIES) -> DataFrame:
    """Per row: id_col and spans (kind, start, end, value, owners, repositories, verdict).

    verdict: example (common_owners owners at least, or common_repositories repositories, HINTED with a word of
    documentation), live (rarer, and at least a digit and a letter among 12 characters or more; of what is assigned to
    a password 6) or weak. Without repo_col an owner is one repository.
    """
    found = written(candidates(docs, id_col, text_col, owner_col, repo_col), "secrets")
    by_row = judged(found, common_owners, common_repositories)
    none = F.array().cast(by_row.schema["spans"].dataType)
    return found.drop("spans").join(by_row, "key", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, common_owners: int = 2, common_repositories: int = REPOSITORIES) -> DataFrame:
    """docs, each live secret's value replaced by [SECRET] in text_col (and n_chars, if there, counted anew).

    Texts are scanned once, and only rows with spans are joined to their verdicts.
    """
    row = F.struct(*docs.columns)
    own = docs.select(row.alias("row"), *_names(id_col, text_col, owner_col, repo_col), F.col(text_col).alias("text"))
    found = spans_of(own, "text", "spans").drop("text").withColumn("n", F.size("spans"))
    found = written(found, "secrets")
    live = F.filter("spans", lambda s: s["verdict"] == "live")
    spans = judged(found.where("n > 0"), common_owners, common_repositories).select("key", live.alias("live"))
    out = found.where("n > 0").select("row", "key").join(spans, "key", "left")
    text = F.col("row")[text_col]

    def replaced(acc: Column, some: Column) -> Column:
        """Some values in a row: the text from the last end to theirs is cut out once, and the rest is done in there."""
        base = acc["at"]
        last = F.greatest(base, F.array_max(F.transform(some, lambda s: s["end"])))
        part = F.substring(text, base + 1, last - base)

        def step(own: Column, s: Column) -> Column:
            again = s["first"] < own["at"]  # inside what an earlier span has covered
            more = F.concat(own["out"], F.substring(own["part"], own["at"] - own["base"] + 1, s["first"] - own["at"]), F.lit("[SECRET]"))
            return F.struct(F.greatest(own["at"], s["end"]).alias("at"), F.when(again, own["out"]).otherwise(more).alias("out"), own["part"].alias("part"), own["base"].alias("base"))

        own = F.aggregate(some, F.struct(base.alias("at"), F.lit("").alias("out"), part.alias("part"), base.alias("base")), step)
        return F.struct(own["at"].alias("at"), F.concat(acc["out"], F.array(own["out"])).alias("out"))

    # A value ends its match.
    by_value = F.array_sort(F.transform("live", lambda s: F.struct((s["end"] - F.length(s["value"])).alias("first"), s["end"].alias("end"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), "")
    done = F.aggregate(in_parts(by_value), begin, replaced, rest)
    out = out.select("row", F.when(F.size("live") > 0, done).alias("done"))
    new = {text_col: F.coalesce("done", text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("done"), F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    columns = [new.get(c, F.col("row")[c]).alias(c) for c in docs.columns]
    return found.where("n = 0").select("row.*").unionByName(out.select(*columns))
