"""URL filters: rules are indexed by their rarest literal token, and a URL's tokens fetch the rules to try.

Rules are written in the usual syntax of filter lists and matched against the address, host and path run together:
`||host/path` fits the host and its subdomains, and paths that start with the rule's; `*` stands for any run and `^` for
one character other than 0-9, A-Z and a-z, or an end; `@@` before a rule makes it allow rather than block. A rule's tokens
are the literal runs of 0-9, A-Z, a-z (as lower case) that any match holds bounded on both sides. Token counts over all
URLs pick the rarest token of each rule as its only index key. A URL is cut into tokens, these look up candidate rules,
and only those run their regular expressions. The fitting rule of highest rank wins; address rules rank by length, above
all pattern rules.

Cases: a null URL or one without "://" has an empty host and path, no rule, and the default verdict; hosts and paths may
hold any character; a rule without any literal token is tried on every URL; rows may repeat; an empty table gives an empty
result; columns other than the id and the URL are not read; long URLs are matched whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.common import LOWER, UPPER, ascii_lower, table

TOKEN = re.compile("[0-9A-Za-z]+")
FOLD = str.maketrans(UPPER, LOWER)
#: A table of more rules than this is refused: every task holds the rules.
MAX_RULES = 2_000_000


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. name: what results show. pattern: searched in host + path. fold: whether the path is lower-cased for it. tokens: literals that a match holds. rank: the highest wins."""

    verdict: str
    name: str | None
    pattern: str
    fold: bool
    tokens: tuple[str, ...]
    rank: int


def _tokens(literal: str, open_left: bool, open_right: bool) -> tuple[str, ...]:
    """Tokens of the literal; runs at * and at an open end may go on in a URL."""
    out = []
    for m in TOKEN.finditer(literal):
        left, right = literal[: m.start()][-1:], literal[m.end() :][:1]
        if left != "*" and right != "*" and (left or not open_left) and (right or not open_right):
            out.append(m[0].translate(FOLD))
    return tuple(out)


def parse_rule(text: str, show: bool = False, fold: bool = True) -> Rule:
    """The rule that a line of a filter list states. show: results name it, and it ranks by length above the others; fold: its path fits in any case."""
    allow, body = text.startswith("@@"), text.removeprefix("@@")
    anchored = body.startswith("||")
    body = body.removeprefix("||")
    parts = {"*": ".*", "^": r"(?:[^0-9A-Za-z]|\A|\Z)"}
    of = lambda s: "".join(parts.get(c) or re.escape(c.translate(FOLD) if fold else c) for c in s)
    if anchored:
        host, rest = re.match("([^/*^]*)(.*)", body, re.DOTALL).groups()
        end = "" if rest.startswith("*") else r"(?=/|\Z)"
        pattern = rf"\A(?:[^/]*\.)?{of(host.translate(FOLD))}{end}{of(rest)}"
        tokens = _tokens(host + rest, False, bool(rest))
    else:
        pattern, tokens = of(body), _tokens(body, True, True)
    return Rule("allow" if allow else "block", body if show else None, pattern, fold, tokens, len(body) + 1_000_000 * show)


#: The rules that the query is to apply.
ADDRESSES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Words that mark advertising, tracking, gambling, adult and pharmacy spam where they stand alone in an address.
SPAM_WORDS = [
    "ads", "adserver", "adult", "affiliate", "baccarat", "banner", "bet", "bets", "betting", "bingo", "casino", "casinos", "cialis", "click", "clicks", "doubleclick", "escort", "gambling", "jackpot",
    "loan", "loans", "lottery", "malware", "payday", "pharmacy", "phishing", "pills", "poker", "popup", "porn", "roulette", "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "warez", "xxx",
]
RULES = [parse_rule(("@@" if v == "allow" else "") + "||" + a, show=True, fold=False) for v, a in ADDRESSES] + [parse_rule(f"^{w}^") for w in SPAM_WORDS]

OUT = "{id} {type}, host string, path string, rule string, verdict string, candidates int, rules_matched int"


def read_rules(lines: DataFrame, column: str = "rule") -> list[Rule]:
    """The rules of a table of filter-list lines; blank ones, comments (!) and nulls are left out."""
    found = lines.select(F.trim(lines[column]).alias("r")).where("r != '' and not startswith(r, '!')").distinct().limit(MAX_RULES + 1).collect()
    if len(found) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [parse_rule(r["r"]) for r in sorted(found)]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(FOLD), re.match("[^?#]*", rest[len(host) :])[0]


def token_counts(urls: DataFrame, url_col: str, vocabulary: set[str]) -> dict[str, int]:
    """How many URLs hold each token that a rule names; no more rows reach the driver than rules have tokens."""
    if not vocabulary:
        return {}
    tokens = F.array_distinct(F.split(ascii_lower(urls[url_col]), "[^0-9a-z]+"))
    named = urls.select(F.explode(F.filter(tokens, lambda t: t.isin(*sorted(vocabulary)))).alias("token"))
    return {r["token"]: r["count"] for r in named.groupBy("token").count().collect()}


class RuleIndex:
    def __init__(self, rules: list[Rule], counts: dict[str, int]) -> None:
        self.always: list[int] = []
        self.by_token: dict[str, list[int]] = {}
        self.rules = rules
        self.compiled: dict[int, re.Pattern] = {}
        for k, r in enumerate(rules):
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)

    def fits(self, k: int, address: str, folded: str) -> bool:
        rule = self.rules[k]
        if k not in self.compiled:
            self.compiled[k] = re.compile(rule.pattern, re.DOTALL)
        return self.compiled[k].search(folded if rule.fold else address) is not None

    def judge(self, host: str, path: str) -> tuple[Rule | None, int, int]:
        """The winner, how many rules were tried, how many fitted."""
        address = host + path
        folded, tried = address.translate(FOLD), [*self.always]
        for t in set(TOKEN.findall(folded)):
            tried += self.by_token.get(t, [])
        fits = [k for k in tried if self.fits(k, address, folded)]
        best = max(fits, key=lambda k: (self.rules[k].rank, -k), default=None)
        return (None if best is None else self.rules[best]), len(tried), len(fits)


def filter_urls(df: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (the winner's name), verdict, candidates (rules tried), rules_matched of each row."""
    counts = token_counts(df, url_col, {t for r in rules for t in r.tokens})

    def judge(batches):
        index = RuleIndex(rules, counts)
        for b in batches:
            rows = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                rule, tried, fits = index.judge(host, path)
                rows.append((host, path, rule.name if rule else None, rule.verdict if rule else default, tried, fits))
            host, path, name, verdict, tried, fits = zip(*rows, strict=True) if rows else ((),) * 6
            arrays = [b.column(0), *(pa.array(x, pa.string()) for x in (host, path, name, verdict)), *(pa.array(x, pa.int32()) for x in (tried, fits))]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "host", "path", "rule", "verdict", "candidates", "rules_matched"])

    source = df.select(df[id_col], df[url_col].cast("string").alias("_url"))
    return source.mapInArrow(judge, OUT.format(id=f"`{id_col}`", type=source.schema[0].dataType.simpleString()))


def op10_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages")).drop("candidates", "rules_matched")


_WORDS = ", ".join(f"'{x}'" for x in SPAM_WORDS)
_FITS = "host = '{h}' OR ends_with(host, '.{h}')"
_RULES = sorted(ADDRESSES, key=lambda x: -len(x[1]))
_WHEN = " ".join(f"WHEN ({_FITS.format(h=a.partition('/')[0])}) AND starts_with(path, '/{a.partition('/')[2]}') THEN '{a}'" for _, a in _RULES)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (SELECT *, CASE {_WHEN} END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({', '.join(f"'{a}'" for v, a in ADDRESSES if v == 'allow')}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN list_has_any(regexp_extract_all({_LOWER.format('host || path')}, '[0-9a-z]+'), [{_WORDS}]) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
