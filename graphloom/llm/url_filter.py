"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens
(runs of ``[a-z0-9-]``) that any URL it fits must hold.  Rules are a table; that
of the defaults is made by ``rule_table``, another can be read from anywhere.
Token counts are taken over all URLs; each rule is filed under its rarest token.
URLs fetch the rules of their own tokens by a join on the token, and only those
run their expressions.  Site rules (host and path, allow or block) win by length;
without one, the pattern rules decide.  All of it is DataFrame expressions.

At most ``MOST_RULES`` rules are broadcast; more are joined by a shuffle.  What a
URL fits is one row for each different URL, added up in the tasks first.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule and is allowed; rules of equal length are taken in code point
order; a rule without a literal token is tried on every URL; repeated URLs are
judged alike; an empty table gives an empty one, and so do no rules (all is
allowed); a very long URL is read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

#: Some 20 MB.
MOST_RULES = 100_000
TOKEN = "[^a-z0-9-]+"

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
SITE_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words that block a host which no site rule fits, as labels or hyphenated parts of labels.
HOST_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "track", "viagra", "xxx")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def site_rule(verdict: str, host: str, path: str) -> Rule:
    host = host.lower()
    tokens = [t for t in re.split(TOKEN, host) if t]
    # a path token at the end of the prefix may go on in the URL: it is no literal token
    tokens += [t for t in re.split(TOKEN, path.lower() if path == path.lower() else "")[:-1] if t]
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{_quote(host)}(?=/|$){_quote(path)}", tuple(dict.fromkeys(tokens)))


def word_rule(word: str) -> Rule:
    """Blocks hosts that have the word between dots or hyphens."""
    return Rule(f"word:{word}", "block", rf"^[^/]*(?<![a-z0-9]){_quote(word)}(?![a-z0-9])", (word,))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ://: the host up to /, ? or #, A-Z lower-cased, and the path up to ? or #."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(F.coalesce(url, F.lit("")), shape, 2)


def url_tokens(host: Column, path: Column) -> Column:
    """Tokens of the host and path, and the hyphenated parts of the host's labels."""
    whole = F.lower(F.concat(host, path))
    return F.array_distinct(F.concat(F.split(whole, TOKEN), F.split(host, "[^a-z0-9]+")))


RULES = "name string, verdict string, pattern string, tokens array<string>, site boolean"


def rule_table(spark: SparkSession, site_rules=SITE_RULES, host_words=HOST_WORDS) -> DataFrame:
    """The rules as a table: name, verdict, pattern, literal tokens, and whether it is a site rule."""
    rows = [(r, True) for r in (site_rule(*x) for x in site_rules)] + [(r, False) for r in (word_rule(w) for w in host_words)]
    return spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), site) for r, site in rows], RULES)


def file_rules(rules: DataFrame, urls: DataFrame, tokens: Column, held) -> DataFrame:
    """The rules with the ``token`` that the fewest URLs hold; an empty one for rules without."""
    each = rules.select("name", F.explode("tokens").alias("token"))
    wanted = each.select("token").distinct()
    counts = urls.select(F.explode(tokens).alias("token")).join(held(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = each.join(counts, "token", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    return rules.join(rarest, "name", "left").select("name", "verdict", "pattern", "site", F.coalesce("least.token", F.lit("")).alias("token"))


def judge(urls: DataFrame, *, url_col: str = "url", id_col: str = "page_id", rules: DataFrame | None = None, most_rules: int = MOST_RULES) -> DataFrame:
    """Per URL: id, host, path, the site rule that fits best, the pattern rule that fits, and the verdict."""
    rules = rule_table(urls.sparkSession) if rules is None else rules.select("name", "verdict", "pattern", "tokens", "site").dropDuplicates(["name"])
    held = F.broadcast if rules.count() <= most_rules else lambda df: df.hint("merge")
    host, path = host_and_path(F.col(url_col))
    base = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    tokens = url_tokens(F.col("host"), F.col("path"))
    filed = file_rules(rules, base, tokens, held)
    some = base.select("host", "path", F.explode(F.concat(tokens, F.array(F.lit("")))).alias("token"))
    fits = some.join(held(filed), "token").where(F.call_function("regexp_like", F.concat("host", "path"), F.col("pattern")))
    # the least of (-length, name): the longest rule, and of those the first
    ranked = F.struct((-F.length("name")).alias("order"), "name", "verdict")
    best = fits.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.min(F.when(F.col("site"), ranked)).alias("_site"), F.min(F.when(~F.col("site"), ranked)).alias("_word"))
    out = base.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    verdict = F.coalesce(F.col("_site.verdict"), F.col("_word.verdict"), F.lit("allow"))
    return out.select(id_col, "host", "path", F.col("_site.name").alias("rule"), F.col("_word.name").alias("pattern_rule"), verdict.alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every ``pages`` url."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_WORDS = "|".join(HOST_WORDS)
OP9_SQL = rf"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|[^a-z0-9])({_WORDS})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
