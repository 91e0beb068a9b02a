"""URL filters by a bit-parallel wildcard automaton.

A rule is a glob over a canonical URL, "." + host + path, where the host ends at the first "/": ``*`` stands for
any run of bytes but "/", ``**`` for any run at all, ``?`` for one byte but "/", and ``\\`` takes the next character
as it is. All rules are packed into one wide state, a bit per element and one per start, in words of 64 bits. A step
shifts the state by one bit, across words too, and keeps what the byte's mask allows (Shift-And); bits whose star
accepts the byte stay (a second mask). So all rules are simulated at once, for many URLs side by side, over each
whole URL; the rules that accept are read off the final state.

Of the rules that accept, the weightiest decides, block before allow, then the first given: rules are packed in that
order, so the lowest accepting bit is the answer. ``host_rule`` makes the rule of a host, its subdomains and a path
prefix; its weight is its length. Where no rule accepts, the URL is allowed.

Nulls and URLs without "://" have an empty host and path, as has an empty URL; they are judged like others (by globs
that accept "."). A URL of any length is judged whole: the few that are much longer than the rest are stepped one by
one, with one wide integer as state. Equal URLs get equal results and repeated rows stay apart. Columns named like an
output are replaced; all others pass through, whatever their names. An empty table gives an empty one. The masks
are sent to every task; rules of more than ``MOST_WORDS`` words of state (16 MB of masks) are refused with an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobath.llm import near_dedup as N
from isobath.llm.shared import shielded, table

U = np.uint64
MOST_WORDS = 4096
# A slice of URLs has at most so many words of state.
STATE_WORDS = 1 << 18
FEW = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Rule(NamedTuple):
    glob: str
    verdict: str
    name: str | None = None
    weight: int = 0


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """The rule of a host and its subdomains, for paths that start with path."""
    plain = "".join("\\" + c if c in "*?\\" else c for c in host + path)
    return Rule(f"*.{plain}**", verdict, host + path, len(host + path))


#: The rules of the query, and what decides where none of them fits.
RULES = [host_rule("org", "/", "allow"), host_rule("example.org", "/es/", "block"), host_rule("example.org", "/en/1", "block"), host_rule("com", "/fr/", "allow"), host_rule("com", "/de/", "block")]
GLOBS = [Rule(g, "block") for g in ("*casino**", "*free-bets**", "*cheap-p?lls**", "*/**.exe", "*.spam.*/**")]


def elements(glob: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """The bytes to consume in order, with their kind, and the stars, each with the number of bytes before it."""
    steps, stars, i = [], [], 0
    while i < len(glob):
        if glob[i] == "*":
            both = glob[i : i + 2] == "**"
            stars.append((len(steps), "any" if both else "run"))
            i += 1 + both
        elif glob[i] == "?":
            steps.append((0, "one"))
            i += 1
        else:
            i += glob[i] == "\\" and i + 1 < len(glob)
            steps += [(b, "byte") for b in glob[i].encode()]
            i += 1
    return steps, stars


class Automaton:
    """The packed rules: masks by byte, of bits that may be entered and of bits that may stay."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = sorted(rules, key=lambda r: (-r.weight, r.verdict != "block"))
        enter, stay, start, accept = [0] * 256, [0] * 256, 0, {}
        at = 0
        for k, rule in enumerate(self.rules):
            steps, stars = elements(rule.glob)
            start |= 1 << at
            for i, (byte, kind) in enumerate(steps, 1):
                for c in [byte] if kind == "byte" else [c for c in range(256) if c != 0x2F]:
                    enter[c] |= 1 << (at + i)
            for i, kind in stars:
                for c in range(256):
                    if kind == "any" or c != 0x2F:
                        stay[c] |= 1 << (at + i)
            at += len(steps)
            accept[at] = k
            at += 1
        self.words = max(1, -(-at // 64))
        if self.words > MOST_WORDS:
            raise ValueError(f"rules of {at} bits; at most {64 * MOST_WORDS}")
        self.enter, self.stay = self._packed(enter), self._packed(stay)
        self.start, self.ends = self._packed([start])[0], self._packed([sum(1 << b for b in accept)])[0]
        self.rule_at = np.full(64 * self.words, -1)
        self.rule_at[list(accept)] = list(accept.values())

    def _packed(self, masks: list[int]) -> np.ndarray:
        return np.frombuffer(b"".join(m.to_bytes(8 * self.words, "little") for m in masks), "<u8").reshape(-1, self.words)

    def _alone(self, state: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The state after the bytes of one URL, as one wide integer."""
        bits = int.from_bytes(state.tobytes(), "little")
        enter, stay = ([int.from_bytes(m.tobytes(), "little") for m in masks] for masks in (self.enter, self.stay))
        for c in rest.tobytes():
            bits = ((bits << 1) & enter[c]) | (bits & stay[c])
        return self._packed([bits])[0]

    def decide(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The place of the deciding rule among self.rules for each of the strings, or -1."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        begin, length = offsets[:-1][order], length[order]
        state = np.tile(self.start, (len(order), 1))
        longer = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")  # of more than t bytes
        for t, m in enumerate(longer):
            if m <= FEW and len(longer) - t > 1000:
                for i in range(m):
                    state[i] = self._alone(state[i], raw[begin[i] + t : begin[i] + length[i]])
                break
            c, now = raw[begin[:m] + t], state[:m]
            moved = now << U(1)
            moved[:, 1:] |= now[:, :-1] >> U(63)
            moved &= self.enter[c]
            now &= self.stay[c]
            now |= moved
        ended = state & self.ends
        word = (ended != 0).argmax(axis=1)
        bits = ended[np.arange(len(ended)), word]
        low = np.maximum(bits & (~bits + U(1)), U(1))
        found = self.rule_at[64 * word + np.log2(low.astype(np.float64)).astype(np.int64)]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(bits != 0, found, -1)
        return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path of a URL; both empty if it is null or has no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """pages with host, path, rule (the name of the deciding rule, if it has one) and verdict."""
    added = ["host", "path", "rule", "verdict"]
    hidden, back = shielded(pages)
    back = [x for c, x in zip(pages.columns, back, strict=True) if c not in added]
    host, path = parts(F.col(hidden[pages.columns.index(url)]))
    given = pages.toDF(*hidden).select("*", host.alias("host"), path.alias("path"))
    schema = T.StructType([*given.schema, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    automaton = Automaton(rules)

    def run(batches):
        names = pa.array([r.name for r in automaton.rules] + [None], pa.string())
        verdicts = pa.array([r.verdict for r in automaton.rules] + ["allow"], pa.string())
        for batch in batches:
            step = max(1, STATE_WORDS // automaton.words)
            found = [np.zeros(0, np.int64)]
            for a in range(0, batch.num_rows, step):
                some = batch.slice(a, step)
                hosts, paths = some.column(some.num_columns - 2), some.column(some.num_columns - 1)
                canonical = pa.compute.binary_join_element_wise(pa.scalar(b".", pa.large_binary()), hosts.cast(pa.large_binary()), paths.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
                found += [automaton.decide(raw, offsets) for _, _, raw, offsets in N._slices(canonical)]
            at = np.concatenate(found)
            at = pa.array(np.where(at < 0, len(automaton.rules), at))
            yield pa.record_batch([*batch.columns, names.take(at), verdicts.take(at)], names=schema.names)

    return given.mapInArrow(run, schema).select(*back, *added)


def op13_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES + GLOBS).drop("url")


def _regex(glob: str) -> str:
    steps, stars = elements(glob)
    at = dict(stars)
    bits = []
    for i in range(len(steps) + 1):
        bits.append({"any": ".*", "run": "[^/]*", None: ""}[at.get(i)])
        if i < len(steps):
            bits.append("[^/]" if steps[i][1] == "one" else f"\\x{{{steps[i][0]:02x}}}")
    return "(?s)" + "".join(bits)


def _fits(rule: Rule) -> str:
    host, _, path = rule.name.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


_BY_LENGTH = sorted(RULES, key=lambda r: -r.weight)
ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.name}'" for r in _BY_LENGTH)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _BY_LENGTH)}
  {" ".join(f"WHEN regexp_full_match('.' || host || path, '{_regex(r.glob)}') THEN '{r.verdict}'" for r in GLOBS)} ELSE 'allow' END AS verdict
FROM p
"""
