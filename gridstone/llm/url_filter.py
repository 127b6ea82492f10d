"""URL filters: glob rules packed into a multiword Shift-And automaton.

Rules are globs over the bytes of a canonical URL, `host` + 0xFF + `path` + `?query`, where
0xFF occurs in no UTF-8 text: `*` runs over anything but that separator, `**` over anything,
`?` is one byte. All rules share one bit vector, a bit for each position of each glob, cut
into 64-bit words. A byte moves every rule at once: shift, AND with the byte's mask, OR the
bits whose wildcard may stay. Batches of URLs step together, one byte of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = 0xFF
ALLOW, BLOCK = "allow", "block"

#: Site rules: host and all its subdomains, path prefix. The longest that fits decides.
SITE_RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))
#: Glob rules for URLs without a site rule: any fitting block rule blocks unless an allow rule fits too. Path globs name lower case only.
GLOB_RULES = (
    ("*casino*|**", BLOCK), ("*cheap-pills*|**", BLOCK), ("*free-bets*|**", BLOCK), ("*spam-farm*|**", BLOCK),
    ("ads.*|**", BLOCK), ("*.ads.*|**", BLOCK), ("ads-*|**", BLOCK), ("*.ads-*|**", BLOCK), ("*adserver*|**", BLOCK), ("*tracker*|**", BLOCK),
    ("*|/cgi-bin/**", BLOCK), ("*|**.exe", BLOCK), ("*|**.zip", BLOCK), ("*|**/login**", BLOCK), ("*|**/cart/**", BLOCK),
)
#: URLs that step through the automaton together.
BATCH = 4096


@dataclass(frozen=True)
class Glob:
    """A compiled rule: classes of bytes to consume, and after how many of them which wildcard may stay (1: *, 2: **)."""

    literals: tuple[int, ...]  # bytes, or -1 for any one byte
    stays: tuple[int, ...]  # one more than literals


def compile_glob(glob: str) -> Glob:
    """`|` stands for the separator. Runs of stars are ** if longer than one."""
    literals: list[int] = []
    stays = [0]
    raw = glob.encode()
    k = 0
    while k < len(raw):
        if raw[k : k + 1] == b"*":
            n = len(raw) - k - len(raw[k:].lstrip(b"*"))
            stays[-1] = max(stays[-1], min(n, 2))
            k += n
            continue
        literals.append({ord("?"): -1, ord("|"): SEPARATOR}.get(raw[k], raw[k]))
        stays.append(0)
        k += 1
    return Glob(tuple(literals), tuple(stays))


class ShiftAnd:
    """All rules as bits of 64-bit words; state k of a rule means that k of its literals are matched."""

    def __init__(self, globs: Sequence[str]):
        rules = [compile_glob(g) for g in globs]
        states = sum(len(r.stays) for r in rules)
        self.words = max(1, -(-states // 64))
        on = np.zeros((256, self.words * 64), dtype=bool)
        stay = np.zeros((256, self.words * 64), dtype=bool)
        first = np.zeros(self.words * 64, dtype=bool)
        self.final: list[int] = []
        at = 0
        for r in rules:
            first[at] = True
            for k, wild in enumerate(r.stays):
                stay[:, at + k] = wild > 0
                stay[SEPARATOR, at + k] = wild > 1
                if k:
                    byte = r.literals[k - 1]
                    on[slice(None) if byte < 0 else byte, at + k] = True
                    on[SEPARATOR, at + k] &= byte == SEPARATOR
            at += len(r.stays)
            self.final.append(at - 1)
        pack = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view("<u8")
        self.on, self.stay, self.first = pack(on), pack(stay), pack(first)

    def fits(self, urls: Sequence[bytes]) -> np.ndarray:
        """Boolean (urls, rules): which rules fit which whole canonical URL."""
        out = np.zeros((len(urls), len(self.final)), dtype=bool)
        order = np.argsort([-len(u) for u in urls], kind="stable")  # longest first: those still running are a prefix
        for block in range(0, len(order), BATCH):
            rows = order[block : block + BATCH]
            sizes = np.array([len(urls[i]) for i in rows])
            joined = np.frombuffer(b"".join(urls[i] for i in rows), dtype=np.uint8)
            starts = np.cumsum(sizes) - sizes
            state = np.repeat(self.first[None, :], len(rows), axis=0)
            for k in range(int(sizes[0]) if len(sizes) else 0):
                n = int(np.searchsorted(-sizes, -k, side="left"))
                byte = joined[starts[:n] + k]
                now = state[:n]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:n] = (moved & self.on[byte]) | (now & self.stay[byte])
            for r, bit in enumerate(self.final):
                out[rows, r] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


def split_url(url: str | None) -> tuple[str, str, str]:
    """host (A-Z lower-cased), path and ?query of a URL; empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    rest = rest.partition("#")[0]
    path, mark, query = rest.partition("?")
    host = host.encode("utf-8", "replace").lower().decode()
    return host, path, mark + query


_RESULT = "host string, path string, rule string, verdict string, glob string"


def judged(url: Column, site_rules=SITE_RULES, glob_rules=GLOB_RULES) -> Column:
    """Struct of host, path, site rule, verdict and the glob that decided, for a URL column."""
    sites = sorted(site_rules, key=lambda r: (-len(r[0]), r[1]))
    globs: list[str] = []
    for rule, _ in sites:
        host, _, path = rule.partition("/")
        globs += [f"{host}|/{path}**", f"*.{host}|/{path}**"]
    globs += [g for g, _ in glob_rules]

    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ShiftAnd(globs)
        for urls in batches:
            parts = [split_url(u) for u in urls]
            fits = automaton.fits([h.encode() + bytes([SEPARATOR]) + (p + q).encode() for h, p, q in parts])
            out = []
            for (host, path, _), fit in zip(parts, fits.tolist()):
                rule = next((k for k in range(len(sites)) if fit[2 * k] or fit[2 * k + 1]), None)
                if rule is not None:
                    out.append((host, path, *sites[rule], None))
                    continue
                hits = [r for r, on in zip(glob_rules, fit[2 * len(sites) :]) if on]
                allowing = next((g for g, v in hits if v == ALLOW), None)
                blocking = next((g for g, v in hits if v == BLOCK), None)
                out.append((host, path, None, BLOCK if blocking and not allowing else ALLOW, allowing or blocking))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "glob"], dtype=object)

    return run(url)


def url_filter(pages: DataFrame, site_rules=SITE_RULES, glob_rules=GLOB_RULES) -> DataFrame:
    """One row per page row: page_id, url, host, path, rule, verdict, glob.

    A null URL or one without `://` has an empty host and path, no rule, and is allowed unless
    a glob fits the empty URL. Repeated rows each get their row. URLs of any length are read whole.
    """
    return pages.select("page_id", "url").withColumn("r", judged(F.col("url"), site_rules, glob_rules)).select("page_id", "url", "r.*")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridstone.llm.common import table

    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _like(glob: str) -> str:
    """A glob as a DuckDB regular expression over host || chr(1) || path_query; chr(1) is taken not to occur in URLs."""
    import re

    out = "".join("[^\x01]*" if t == "*" else ".*" if t == "**" else "\x01" if t == "|" else re.escape(t).replace("/", "/") for t in re.findall(r"\*\*|\*|\||[^*|]+", glob))
    return out.replace("'", "''").replace("\x01", "\\x01")


def oracle() -> str:
    lower = "translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sites = sorted(SITE_RULES, key=lambda r: (-len(r[0]), r[1]))
    fits = [f"(host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}')" for r, _ in sites]
    rule = " ".join(f"when {f} then '{r}'" for f, (r, _) in zip(fits, sites))
    verdict = " ".join(f"when {f} then '{v}'" for f, (_, v) in zip(fits, sites))
    globs = " or ".join(f"regexp_full_match(host || chr(1) || path || query, '{_like(g)}', 's')" for g, _ in GLOB_RULES)
    return f"""
with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
b as (select page_id, regexp_extract(r, '^[^/?#]*') as h, substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1) as t from a),
c as (select page_id, {lower} as host, regexp_extract(t, '^[^?#]*') as path,
             substr(regexp_extract(t, '^[^#]*'), length(regexp_extract(t, '^[^?#]*')) + 1) as query from b)
select page_id, host, path, case {rule} end as rule, case {verdict} when {globs} then 'block' else 'allow' end as verdict from c"""
