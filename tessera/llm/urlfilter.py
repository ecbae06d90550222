"""URL filters: pattern rules indexed by their rarest literal token.

DataFrame and SQL functions only. A rule is a pattern over an address. Its
literal tokens (runs of letters and digits that the pattern closes on both
sides) must be whole tokens of any address that it matches, so each rule is
listed under just one of them: the one that the fewest addresses have. An
address looks up its own tokens, and only the rules found run their regular
expression. Rules without such a token are tried on every address.

Patterns: ``||`` at the start is the start of the host or of one of its labels,
``|`` at the start or end that end of the address, ``*`` any characters, ``^`` one
character that is no letter, digit or one of ``_-.%`` (or the end); all else is
literal. An address is host and rest without the scheme, A-Z lower-cased. A site rule
``host/path`` fits its host and all subdomains where the path, its case kept, starts with the rule's.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The site rules of the query.
SITES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# Pages that are no prose, by address; the allowed ones are exceptions.
PATTERNS = [
    ("||ads.", "block"), ("||adserver.", "block"), ("||tracker.", "block"), ("||cdn.*.js|", "block"), ("^login^", "block"),
    ("^signin^", "block"), ("^signup^", "block"), ("^wp-admin^", "block"), ("^cart^", "block"), ("^checkout^", "block"),
    ("^porn^", "block"), ("^xxx^", "block"), ("^casino^", "block"), (".exe|", "block"), (".zip|", "block"), ("^sessionid=", "block"),
    ("^help^login^", "allow"),
]
LITERAL_RULES = 20_000      # rules held beside every row; more are joined
_SEPARATOR = r"(?:[^a-z0-9_.%-]|\z)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST = r"^(?:[^/?#]*\.)?"


@dataclass(frozen=True)
class Rule:
    """``text`` as given, ``site``: exact host and path; ``rank``: the highest matching rule wins."""

    text: str
    verdict: str
    site: bool
    rank: int
    regex: str
    tokens: tuple[str, ...]


def _lower(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def _escaped(text: str) -> str:
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", text)


def _closed_tokens(text: str, left_open: bool, right_open: bool) -> set[str]:
    """Tokens of a literal stretch that nothing outside it can lengthen."""
    out = set()
    for m in re.finditer("[a-z0-9]+", _lower(text)):
        if not (left_open and m.start() == 0 or right_open and m.end() == len(text)):
            out.add(m.group())
    return out


def _site(text: str) -> tuple[str, set[str]]:
    host, slash, path = text.partition("/")
    regex = _HOST + _escaped(_lower(host)) + (_escaped(slash + path) if slash else r"(?:/|\z)")
    return regex, _closed_tokens(text, False, bool(slash))


def _pattern(text: str) -> tuple[str, set[str]]:
    text = _lower(text)
    regex, start, end = "", False, text.endswith("|") and len(text) > 1
    if text.startswith("||"):
        regex, start, text = _HOST, True, text[2:]
    elif text.startswith("|"):
        regex, start, text = "^", True, text[1:]
    text = text[:-1] if end else text
    parts, tokens = re.split(r"([*^])", text), set()
    for i, p in enumerate(parts):
        regex += {"*": "(?s:.*)", "^": _SEPARATOR}.get(p) or _escaped(p)
        if p not in ("*", "^"):
            tokens |= _closed_tokens(p, not start if i == 0 else parts[i - 1] == "*",
                                     not end if i == len(parts) - 1 else parts[i + 1] == "*")
    return regex + (r"\z" if end else ""), tokens


def compile_rules(sites: Sequence[tuple[str, str]] = (), patterns: Sequence[tuple[str, str]] = ()) -> list[Rule]:
    """Rules with their precedence: any site rule beats any pattern, the longer site rule the shorter, an
    allowing pattern a blocking one; ties go to the rule that comes last by its text. Repeated rules count once."""
    keyed = sorted({(1, len(t), v, t) for t, v in sites} | {(0, v == "allow", v, t) for t, v in patterns})
    out = []
    for rank, (site, _, verdict, text) in enumerate(keyed):
        regex, tokens = _site(text) if site else _pattern(text)
        out.append(Rule(text, verdict, bool(site), rank, regex, tuple(sorted(tokens))))
    return out


def _parts(url: Column) -> Column:
    """struct(host, path, site, address, tokens) of a URL; all empty for a null or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    address = F.translate(rest, _UPPER, _LOWER)
    return F.struct(host.alias("host"), path.alias("path"), F.concat(host, path).alias("site"), address.alias("address"),
                    F.array_distinct(F.filter(F.split(address, "[^a-z0-9]+"), lambda t: t != "")).alias("tokens"))


def _with_parts(pages: DataFrame, url_col: str) -> DataFrame:
    """The caller's row as ``own``, and ``u`` from its URL."""
    return pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("own"),
                        F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url")) \
        .select("own", _parts(F.col("url")).alias("u"))


def rarest_tokens(rows: DataFrame, rules: Sequence[Rule]) -> dict[str, list[Rule]]:
    """Rules by the token of theirs that the fewest of all addresses have (ties: first by alphabet);
    those without one under the empty token. One number a token of the rules reaches the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    few = rows.sparkSession.range(1).select(F.explode(F.split(F.lit(",".join(wanted)), ",")).alias("t"))
    found = rows.select(F.explode("u.tokens").alias("t")).join(F.broadcast(few) if len(wanted) <= LITERAL_RULES else few, "t") \
        .groupBy("t").count().collect() if wanted else []
    n = {r["t"]: r["count"] for r in found}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (n.get(t, 0), t), default=""), []).append(r)
    return index


_RULE = "struct<token: string, rank: int, rule: string, site: boolean, verdict: string, regex: string>"


def _entry(token: str, r: Rule) -> dict:
    return {"token": token, "rank": r.rank, "rule": r.text, "site": r.site, "verdict": r.verdict, "regex": r.regex}


def _fits(c: Column, u: Column) -> Column:
    return F.rlike(F.when(c.site, u.site).otherwise(u.address), c.regex)


def _looked_up(rows: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """Adds n_tried and best, with the index as one literal array of buckets by the token's CRC-32."""
    size = 1 << max(4, len(index).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for t in index:
        if t:
            buckets[zlib.crc32(t.encode()) % size] += [_entry(t, r) for r in index[t]]
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<{_RULE}>>")
    always = F.from_json(F.lit(json.dumps([_entry("", r) for r in index.get("", [])])), f"array<{_RULE}>")
    u = F.col("u")
    tried = F.concat(always, F.flatten(F.transform(u.tokens, lambda t: F.filter(
        F.get(table, (F.crc32(t) % size).cast("int")), lambda c: c.token == t))))
    fit = F.filter("tried", lambda c: _fits(c, u))
    return rows.withColumn("tried", tried).select("own", "u", F.size("tried").alias("n_tried"), F.array_max(F.transform(
        fit, lambda c: F.struct(c["rank"].alias("rank"), c.rule.alias("rule"), c.site.alias("site"), c.verdict.alias("verdict")))).alias("best"))


def _joined(rows: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """The same by a join of each different address' tokens with the rules' tokens, for long rule lists."""
    entries = json.dumps([_entry(t, r) for t, rules in index.items() for r in rules])
    rules = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(entries), f"array<{_RULE}>")))
    different = rows.select("u.site", "u.address", "u.tokens").dropDuplicates(["site", "address"])
    u, c = F.struct(F.col("at").alias("site"), "address"), F.struct("site", "regex")
    tried = different.select(F.col("site").alias("at"), "address", F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token")) \
        .join(rules, "token").withColumn("fits", _fits(c, u))
    found = tried.groupBy("at", "address").agg(F.count("*").cast("int").alias("n_tried"), F.max(F.when(
        F.col("fits"), F.struct("rank", "rule", "site", "verdict"))).alias("best"))
    return rows.join(found, (rows.u.site == found.at) & (rows.u.address == found.address), "left") \
        .select("own", "u", F.coalesce("n_tried", F.lit(0)).alias("n_tried"), "best")


def judge(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", literal_rules: int = LITERAL_RULES) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule (the site rule that decides), pattern (the pattern that
    decides), verdict (allow where nothing fits) and n_tried (rules whose expression ran).

    A null URL or one without ``://`` has an empty host and path and fits only patterns that fit the empty
    address. Columns of the same names are replaced; repeated rows stay; an empty table gives no rows. Up to
    ``literal_rules`` rules go with the plan, more are joined by token.
    """
    rows = _with_parts(pages, url_col)
    index = rarest_tokens(rows, rules)
    judged = (_looked_up if len(rules) <= literal_rules else _joined)(rows, index)
    new = {"host": F.col("u.host"), "path": F.col("u.path"), "rule": F.when(F.col("best.site"), F.col("best.rule")),
           "pattern": F.when(~F.col("best.site"), F.col("best.rule")),
           "verdict": F.coalesce("best.verdict", F.lit("allow")), "n_tried": F.col("n_tried")}
    return judged.select(*[F.col("own")[c].alias(c) for c in pages.columns if c not in new], *[x.alias(c) for c, x in new.items()])


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: by the longest site rule that fits, else by the patterns."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, compile_rules(SITES, PATTERNS)).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rules = compile_rules(SITES, PATTERNS)
    quoted = [x.regex.replace("'", "''") for x in rules]
    best = ", ".join(f"CASE WHEN regexp_matches({'host || path' if r.site else 'address'}, '{q}') THEN {r.rank} END"
                     for r, q in zip(rules, quoted))
    name = reduce(lambda a, r: f"{a} WHEN {r.rank} THEN '{r.text}'", [r for r in rules if r.site], "CASE best")
    allowed = ", ".join(str(r.rank) for r in rules if r.verdict == "allow")
    return f"""SELECT page_id, host, path, {name} END AS rule,
  CASE WHEN best IS NULL OR best IN ({allowed}) THEN 'allow' ELSE 'block' END AS verdict
FROM (SELECT *, greatest({best}) AS best FROM (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, translate(rest, '{_UPPER}', '{_LOWER}') AS address
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)))"""


QUERIES = {"op12_url_filters": op12_url_filters}
ORACLES = {"op12_url_filters": _oracle()}
