"""URL filters: glob rules as one bit-parallel automaton that reads each canonical URL once."""
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

ALLOW, BLOCK = "allow", "block"
# Rules by host and path: they fit the host and its subdomains, and paths that start so. The longest one decides.
SITES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))
# Globs over "." + host + path, for what no site rule decides. `*` is any run without a slash, `**` any run, `?` one
# ASCII character but a slash, [..] one of several. The glob with the most fixed characters decides, of equals the first one.
GLOBS = (
    (ALLOW, "*.gov/**"), (ALLOW, "*.edu/**"), (ALLOW, "*.wikipedia.org/**"),
    (BLOCK, "*casino*/**"), (BLOCK, "*casino*"), (BLOCK, "*poker*/**"), (BLOCK, "*slots[-.]*/**"), (BLOCK, "*betting*/**"), (BLOCK, "*jackpot*/**"),
    (BLOCK, "*[.-]adult[.-]*/**"), (BLOCK, "*[.-]adult[.-]*"), (BLOCK, "*[.-]xxx[.-]*/**"), (BLOCK, "*.xxx/**"), (BLOCK, "*porn*/**"), (BLOCK, "*sexcam*/**"), (BLOCK, "*escort[.-]*/**"),
    (BLOCK, "*[.-]pills[.-]*/**"), (BLOCK, "*[.-]pills[.-]*"), (BLOCK, "*cheap-*/**"), (BLOCK, "*pharma-online*/**"), (BLOCK, "*viagra*/**"), (BLOCK, "*replica-watch*/**"),
    (BLOCK, "*payday-loan*/**"), (BLOCK, "*free-download*/**"), (BLOCK, "*warez*/**"), (BLOCK, "*torrent*/**"), (BLOCK, "*keygen*/**"), (BLOCK, "*cracked-*/**"),
    (BLOCK, ".ads.*/**"), (BLOCK, ".ad?.*/**"), (BLOCK, ".tracker.*/**"), (BLOCK, ".pixel.*/**"), (BLOCK, "*.doubleclick.net/**"),
    (BLOCK, "**/wp-admin/**"), (BLOCK, "**/wp-login.php"), (BLOCK, "**/cgi-bin/**"), (BLOCK, "**/login"), (BLOCK, "**/login/**"), (BLOCK, "**/signin"), (BLOCK, "**/checkout/**"),
    (BLOCK, "**/cart/**"), (BLOCK, "**/search/**"), (BLOCK, "**/tag/*/page/**"), (BLOCK, "**/calendar/[12][0-9][0-9][0-9]/**"),
    (BLOCK, "**.exe"), (BLOCK, "**.zip"), (BLOCK, "**.tar.gz"), (BLOCK, "**.dmg"), (BLOCK, "**.apk"), (BLOCK, "**.iso"), (BLOCK, "**.mp[34]"), (BLOCK, "**.avi"),
    (BLOCK, "**.jpg"), (BLOCK, "**.jpeg"), (BLOCK, "**.png"), (BLOCK, "**.gif"), (BLOCK, "**.css"), (BLOCK, "**.js"),
)
# The verdict where no rule fits.
OTHERWISE = ALLOW
# Bits that all rules may have together; the masks of a byte then take at most 64 kB, and all of them 16 MB.
BITS = 1 << 18
# URLs that one step advances together; the last few, which are longer than all others, are read one by one.
TOGETHER, FEW = 4096, 8


@dataclass(frozen=True)
class Rule:
    verdict: str
    glob: str
    name: str | None = None

    @property
    def parts(self) -> list[tuple[frozenset[int], str]]:
        """(bytes that one place takes, what may be repeated before it); a last place of no bytes ends the rule."""
        out, gap, at = [], "", 0
        data = self.glob.encode()
        while at < len(data):
            if data[at:at + 2] == b"**":
                gap, at = "**", at + 2
            elif data[at:at + 1] == b"*":
                gap, at = gap or "*", at + 1
            else:
                if data[at:at + 1] == b"[":
                    end = data.index(b"]", at + 2)
                    taken, at = _bracket(data[at + 1:end]), end + 1
                elif data[at:at + 1] == b"?":
                    taken, at = frozenset(range(128)) - {47}, at + 1
                else:
                    at += data[at:at + 1] == b"\\" and at + 1 < len(data)
                    taken, at = frozenset((data[at],)), at + 1
                out.append((taken, gap))
                gap = ""
        return [*out, (frozenset(), gap)]

    @property
    def weight(self) -> int:
        """Places that only one byte fits."""
        return sum(len(taken) == 1 for taken, _ in self.parts)


def _bracket(inside: bytes) -> frozenset[int]:
    out, at = set(), 0
    while at < len(inside):
        if inside[at + 1:at + 2] == b"-" and at + 2 < len(inside):
            out |= set(range(inside[at], inside[at + 2] + 1))
            at += 3
        else:
            out.add(inside[at])
            at += 1
    return frozenset(out)


def quoted(text: str) -> str:
    """The text as a glob that fits only itself."""
    return "".join(f"\\{c}" if c in "*?[\\" else c for c in text)


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains, as a canonical URL has a dot before its host."""
    return Rule(verdict, f"*.{quoted(host)}{quoted(path)}**", host + path)


class Automaton:
    """All rules as one row of bits, 64 to a word; a rule may begin in one word and end in the next.

    Bit k of a rule says that its first k places are read. A byte moves the bits whose next place takes it one to the
    left, and keeps those before a star that takes it.
    """

    def __init__(self, rules: list[Rule]):
        parts = [r.parts for r in rules]
        sizes = [len(p) for p in parts]
        if sum(sizes) > BITS:
            raise ValueError(f"rules of {sum(sizes)} places; filter in several passes of at most {BITS}")
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
        self.words = max(1, -(-sum(sizes) // 64))
        self.rules = rules
        self.start = np.zeros(self.words, np.uint64)
        self.move, self.keep = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        for at, places in zip(first.tolist(), parts):
            self._set(self.start, at)
            for k, (taken, gap) in enumerate(places):
                for byte in taken:
                    self._set(self.move[byte], at + k)
                for byte in range(256) if gap else ():
                    if gap == "**" or byte != 47:
                        self._set(self.keep[byte], at + k)
        last = first + np.array(sizes, np.int64) - 1
        self.last_word, self.last_bit = last >> 6, (last & 63).astype(np.uint64)
        self._whole: tuple | None = None

    @staticmethod
    def _set(row: np.ndarray, at: int) -> None:
        row[at >> 6] |= np.uint64(1 << (at & 63))

    def _step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        moved = state & self.move[codes]
        out = (moved << np.uint64(1)) | (state & self.keep[codes])
        out[:, 1:] |= moved[:, :-1] >> np.uint64(63)
        return out

    def _alone(self, state: np.ndarray, data: bytes) -> np.ndarray:
        """One URL, with the words of its state as one number."""
        if self._whole is None:
            self._whole = tuple([int.from_bytes(row.astype("<u8").tobytes(), "little") for row in masks] for masks in (self.move, self.keep))
        move, keep = self._whole
        at = int.from_bytes(state.astype("<u8").tobytes(), "little")
        for byte in data:
            if not at:
                break
            at = ((at & move[byte]) << 1) | (at & keep[byte])
        return np.frombuffer(at.to_bytes(8 * self.words, "little"), "<u8").astype(np.uint64)

    def fits(self, urls: list[bytes]) -> np.ndarray:
        """(URLs, rules): which rules fit the whole of each URL. All URLs take a step at once, the longer ones go on."""
        out = np.zeros((len(urls), len(self.rules)), bool)
        order = sorted(range(len(urls)), key=lambda k: -len(urls[k]))
        for k in range(0, len(order), TOGETHER):
            own = order[k:k + TOGETHER]
            out[own] = self._together([urls[j] for j in own])
        return out

    def _together(self, urls: list[bytes]) -> np.ndarray:
        lengths = np.array([len(u) for u in urls], np.int64)
        state = np.tile(self.start, (len(urls), 1))
        steps = int(lengths[FEW]) if len(urls) > FEW else 0
        codes = np.zeros((len(urls), steps), np.uint8)
        for k, url in enumerate(urls):
            part = url[:steps]
            codes[k, :len(part)] = np.frombuffer(part, np.uint8)
        running = len(urls)
        for t in range(steps):
            while running and lengths[running - 1] <= t:
                running -= 1
            state[:running] = self._step(state[:running], codes[:running, t])
        for k in range(min(FEW, len(urls))):
            state[k] = self._alone(state[k], urls[k][steps:])
        return (state[:, self.last_word] >> self.last_bit) & np.uint64(1) == 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first `://` up to a slash, question mark, hash or the end, A-Z as a-z. Path: on up to a question
    mark, hash or the end. A null and one without `://` have neither."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _preferred(rules: list[Rule]) -> np.ndarray:
    """Numbers of the rules, those that decide first: site rules by length, then globs by their fixed characters."""
    return np.array(sorted(range(len(rules)), key=lambda k: (rules[k].name is None, -len(rules[k].name or ""), -rules[k].weight, k)), np.int64)


def judge(pages: DataFrame, sites: tuple = SITES, globs: tuple = GLOBS, otherwise: str = OTHERWISE) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern), one row for each row of pages.

    rule: the longest site rule that fits; where none does, pattern is the preferred glob that fits. The verdict is that of
    the one that decides, `otherwise` where there is none. A null URL has an empty host and path, which no site rule
    fits. Repeated rows get equal answers, null ids stay null, further columns play no part, and an empty table gives an
    empty one. Rules come from the caller, not from a table, and are bounded by BITS.
    """
    rules = [site_rule(*s) for s in sites] + [Rule(*g) for g in globs]
    order = _preferred(rules)
    sent = pages.sparkSession.sparkContext.broadcast(Automaton([rules[k] for k in order.tolist()]))

    @pandas_udf("int")
    def deciding(urls: pd.Series) -> pd.Series:
        fits = sent.value.fits([u.encode() for u in urls])
        return pd.Series(np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if fits.shape[1] else np.full(len(urls), -1), dtype="int32")

    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("k", deciding(F.concat(F.lit("."), "host", "path")))
    own = [rules[k] for k in order.tolist()]

    def told(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]).cast("array<string>"), F.col("k")) if values else F.lit(None).cast("string")
    return rows.select("page_id", "host", "path", told([r.name for r in own]).alias("rule"),
                       F.coalesce(told([r.verdict for r in own]), F.lit(otherwise)).alias("verdict"),
                       told([None if r.name else r.glob for r in own]).alias("pattern"))


def allowed(pages: DataFrame, **rules) -> DataFrame:
    """The rows of pages whose URL is allowed, with their columns."""
    kept = judge(pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page_id"), "url"), **rules)
    return kept.filter(F.col("verdict") == ALLOW).select("page_id.*")


def _regex(rule: Rule) -> str:
    """The rule as an expression of SQL."""
    out = "^"
    for taken, gap in rule.parts:
        out += {"": "", "*": "[^/]*", "**": "(?s:.)*"}[gap]
        if len(taken) == 127:
            out += "[\\x00-\\x2E\\x30-\\x7F]"
        elif taken:
            out += "[" + "".join(f"\\x{b:02X}" for b in sorted(taken)) + "]"
    return out + "$"


_OWN = [site_rule(*s) for s in SITES] + [Rule(*g) for g in GLOBS]
_VALUES = ", ".join(f"({k}, {_OWN[j].name and repr(_OWN[j].name) or 'NULL'}, '{_OWN[j].verdict}', {repr(_OWN[j].glob) if not _OWN[j].name else 'NULL'}, '{_regex(_OWN[j])}')"
                    for k, j in enumerate(_preferred(_OWN).tolist()))
VERDICTS_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
hosts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(k, rule, verdict, pattern, form) AS (VALUES {_VALUES}),
urls AS (SELECT DISTINCT host, path FROM hosts),
hits AS (SELECT host, path, min(k) AS k FROM urls JOIN rules ON regexp_matches('.' || host || path, form) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, '{OTHERWISE}') AS verdict, pattern
FROM hosts LEFT JOIN hits USING (host, path) LEFT JOIN rules USING (k)"""
