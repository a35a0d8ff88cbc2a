"""URL filters: rules indexed by their rarest literal token.

A rule is either a prefix, `host/path`, which fits its host and all subdomains where the path starts with the rule's, or a pattern over
the whole url (any rule with one of the signs `*^|`): `*` is any text, `^` one sign that is no letter or digit, or either end, `|` at an
end of the rule an end of the url, and `||` at its beginning the beginning of a host or of a part of one.

A url is a set of tokens, runs of letters and digits. Of each rule those tokens are known that stand whole in every url that it can fit;
the one in the fewest urls is its key. A url fetches the rules of its tokens, and only these run as regular expressions. Rules without
such a token have the empty key, which every url has.

Scale: one count of the rules' tokens, one join by token and one by row, by Spark's own functions. A table of rules is broadcast up to
`BROADCAST_BYTES`, as counted; beyond, keys with many urls are dealt out over salts, as many as their count asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galewise.llm.common import written

#: Prefixes and their verdicts.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Patterns of urls that a training corpus does without, and exceptions from them.
PATTERNS = (
    ("^adult^x^", "block"),
    ("^porn^", "block"),
    ("^xxx^", "block"),
    ("^casino^", "block"),
    ("^free^bets^", "block"),
    ("^sports^betting^", "block"),
    ("^cheap^pills^", "block"),
    ("^buy^*^viagra^", "block"),
    ("^spam^farm^", "block"),
    ("^ads^track^", "block"),
    ("||doubleclick^", "block"),
    ("^replica^watches^", "block"),
    ("^payday^loans^", "block"),
    ("^warez^", "block"),
    ("^wp^login^php", "block"),
    ("^responsible^gambling^", "allow"),
    ("^casino^royale^film^", "allow"),
)
#: Rules are sent to all tasks up to so many bytes; urls of one key that stand in one task of a join else.
BROADCAST_BYTES, ROWS_PER_SALT = 8 << 20, 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Signs that expressions have quoted; and those that part tokens, but for the star, behind which a token may go on.
_QUOTED, _BOUND = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", "[\\x00-\\x29\\x2B-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
_TOKEN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_EDGE = "(?:[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]|^|$)"


def _low(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def rule_table(spark: SparkSession, rules=RULES + PATTERNS) -> DataFrame:
    """(rule, verdict) as a table. Longer lists are read from where they are."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules])))


def with_parts(pages: DataFrame, url_col: str = "url") -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path of a url; both empty for null or where there is no ://."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return _low(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def compiled(rules: DataFrame) -> DataFrame:
    """(rule, verdict, prefix, regex, tokens) of distinct rules: prefix says which kind a rule is, its expression runs on host and path for
    prefixes and on the lower-cased url for patterns; tokens stand whole wherever it fits. Null rules or verdicts are left out."""
    given = rules.filter("rule is not null and verdict is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    given = given.withColumn("prefix", ~F.col("rule").rlike("[*^|]"))
    host = _low(F.substring_index("rule", "/", 1))
    path = F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")
    quoted = lambda c: F.regexp_replace(c, f"({_QUOTED})", "\\\\$1")
    prefix = F.concat(F.lit("^(?:[^/]*\\.)?"), quoted(host), F.when(path == "", F.lit("(?:/|$)")).otherwise(quoted(path)))
    pattern = quoted(_low(F.col("rule")))
    pattern = F.regexp_replace(pattern, r"^\\\|\\\|", r"^[^/?#]*://(?:[^/?#]*\\.)?")
    pattern = F.regexp_replace(F.regexp_replace(pattern, r"^\\\|", "^"), r"\\\|$", r"\$")
    pattern = F.replace(F.replace(pattern, F.lit("\\*"), F.lit("(?s:.*)")), F.lit("\\^"), F.lit(_EDGE))
    literal = F.when(F.col("prefix"), F.concat(F.lit("."), host, F.when(path == "", F.lit("/")).otherwise(_low(path)))).otherwise(_low(F.col("rule")))
    tokens = F.array_distinct(F.regexp_extract_all(literal, F.lit(f"(?<={_BOUND}){_TOKEN}(?={_BOUND})"), F.lit(0)))
    return given.select("rule", "verdict", "prefix", F.when(F.col("prefix"), prefix).otherwise(pattern).alias("regex"), tokens.alias("tokens"))


def candidates(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule, verdict, prefix, regex): the rules that urls fetch by their tokens. keyed has row and tokens, rules is of compiled()."""
    own, _ = written(rules, "rules")
    tokens = keyed.select("row", F.explode("tokens").alias("token"))
    known = own.select(F.explode("tokens").alias("token")).distinct().unionByName(own.sparkSession.range(1).select(F.lit("").alias("token")))
    size = own.agg(F.sum(F.octet_length("rule") + F.octet_length("regex") + 64)).first()[0] or 0
    sent = F.broadcast if size <= BROADCAST_BYTES else lambda df: df
    counts, _ = written(tokens.join(sent(known), "token").groupBy("token").agg(F.count("*").alias("n")), "counts")
    listed = own.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    rarest = listed.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("key"))
    index = own.drop("tokens").join(rarest, "rule").select("rule", "verdict", "prefix", "regex", "key.*")
    if size <= BROADCAST_BYTES:
        return tokens.join(F.broadcast(index.drop("n")), "token").drop("token")
    salts = (F.floor(F.col("n") / ROWS_PER_SALT) + 1).cast("int")
    hot = counts.filter(F.col("n") >= ROWS_PER_SALT).select("token", salts.alias("salts"))  # one in a million urls at most
    dealt = tokens.join(F.broadcast(hot), "token", "left").withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int"))
    spread = index.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return dealt.drop("salts").join(spread, ["token", "salt"]).drop("token", "salt")


def judged(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, host, path, rule (the longest prefix that fits, else null), verdict and pattern (the pattern
    that fits; null if none does or a prefix decides).

    The verdict is that of the longest prefix; without one allow, if a pattern with that verdict fits, else block, if any does, else
    allow. Of prefixes of one length the last by code point counts, of one rule with two verdicts block. Null urls and those without ://
    have an empty host and path and fit no prefix; patterns see them as they stand, null as empty. Repeated rows give repeated rows, null ids stay; an empty
    table gives none, no rules allow all. Urls of any length are searched whole; other columns are ignored.
    """
    host, path = with_parts(pages, url_col)
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(F.col("low"), F.lit(_TOKEN), F.lit(0)), F.array(F.lit(""))))
    keyed = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), _low(F.coalesce(F.col(url_col), F.lit(""))).alias("low"))
    keyed, _ = written(keyed, "urls")
    found = candidates(keyed.select("row", tokens.alias("tokens")), compiled(rule_table(pages.sparkSession) if rules is None else rules))
    met = keyed.join(found, "row", "left")
    fits = F.regexp_like(F.when(F.col("prefix"), F.concat("host", "path")).otherwise(F.col("low")), F.col("regex"))
    prefix = F.max(F.when(F.col("prefix") & fits, F.struct(F.length("rule").alias("size"), "rule", "verdict"))).alias("p")
    pattern = F.max(F.when(~F.col("prefix") & fits, F.struct((F.col("verdict") == "allow").alias("allows"), F.length("rule").alias("size"), "rule", "verdict"))).alias("q")
    best = met.groupBy("row", "id", "host", "path").agg(prefix, pattern)
    verdict = F.coalesce("p.verdict", "q.verdict", F.lit("allow"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("p.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("p").isNull(), F.col("q.rule")).alias("pattern"))


def _sql_regex(rule: str) -> str:
    """The expression of a pattern in SQL's dialect; ~ stands for the edge of a token."""
    host, rest = ("^[^/?#]*://([^/?#]*[.])?", rule[2:]) if rule.startswith("||") else ("", rule)
    return "(?s)" + host + rest.replace("^", "~").replace("*", ".*")


_PREFIXES = ", ".join(f"('{r}', '{v}', '{r.split('/')[0]}', '{r[r.index('/') :]}')" for r, v in RULES)
_PATTERNS = ", ".join(f"('{r}', '{v}',  replace('{_sql_regex(r)}', '~', '([^a-z0-9\\x{{80}}-\\x{{10FFFF}}]|^|$)'))" for r, v in PATTERNS)
#: The same in SQL: all rules against all urls.
ORACLE = f"""
with cut as (select page_id, coalesce(url, '') as url, row_number() over () as k, case when contains(coalesce(url, ''), '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
u as (select page_id, k, translate(url, '{_UPPER}', '{_LOWER}') as low, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
prefixes(rule, verdict, h, p) as (values {_PREFIXES}),
patterns(rule, verdict, regex) as (values {_PATTERNS}),
a as (select k, arg_max(struct_pack(rule := rule, verdict := verdict), length(rule)) as hit from u join prefixes on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by k),
b as (select k, first(struct_pack(rule := rule, verdict := verdict) order by verdict = 'allow' desc, length(rule) desc, rule desc) as hit from u join patterns on regexp_matches(low, regex) group by k)
select u.page_id, host, path, a.hit.rule as rule, coalesce(a.hit.verdict, b.hit.verdict, 'allow') as verdict, case when a.hit is null then b.hit.rule end as pattern
from u left join a using (k) left join b using (k)
"""
