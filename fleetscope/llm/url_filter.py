"""URL filters: glob rules run as one bit-parallel wildcard automaton.

Every rule becomes a pattern over the canonical url: ``.host``, a byte that no text holds, and the path. ``*`` stands for any
bytes of one side. All patterns are packed, one bit a position, into 64-bit words; one Shift-And step a byte moves all
patterns at once, and all urls of a batch move together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow


#: Parts host and path; no UTF-8 text holds this byte, and no wildcard takes it.
PART = b"\xff"


@dataclass(frozen=True)
class Rule:
    """host: fits itself and its subdomains; path: a prefix. ``host_glob`` (over ``.host``) and ``path_glob`` replace them, each for its side."""

    verdict: str
    host: str = ""
    path: str = ""
    host_glob: str = ""
    path_glob: str = ""

    @property
    def name(self) -> str:
        return self.host_glob + self.path_glob or self.host + self.path

    @property
    def pattern(self) -> bytes:
        if self.host_glob or self.path_glob:
            return (self.host_glob or "*").encode() + PART + (self.path_glob or "*").encode()
        return f"*.{self.host}".encode() + PART + f"{self.path}*".encode()


#: The stated rules.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))

#: Where no stated rule fits. Names that hosts of advertising, tracking, gambling, pharmacies, adult sites, spam and
#: link shorteners begin a label with (a label that is or begins ``name-`` for the first list, begins with the name for the second).
LABELS = (
    "ad ads adserver adservice adclick adtrack advert adverts banner banners click clicks clickbait counter metrics pixel popads popunder stats telemetry tracker tracking affiliate affiliates"
    " bet bets betting bingo free-bets jackpot lotto lottery poker roulette slots sportsbook adult cams escort escorts hardcore hentai milf nude porn sex webcams xxx cialis levitra cheap-pills pills pharma viagra"
    " spam spam-farm seo-farm link-farm linkfarm payday-loans quick-loans crypto-giveaway free-prizes get-rich replica-watches"
).split()
PREFIXES = "casino doubleclick googlesyndication porno sexcam onlinecasino onlinepharmacy viagra warez phishing".split()
HOSTS = "bit.ly tinyurl.com goo.gl t.co ow.ly is.gd adf.ly taboola.com outbrain.com criteo.com scorecardresearch.com quantserve.com".split()
#: Files that hold no page, and parts of sites that hold forms, carts, searches and scripts.
SUFFIXES = "7z apk avi bin bz2 css deb dmg exe gif gz ico iso jar jpeg jpg js mkv mov mp3 mp4 msi otf png rar rpm svg tar tgz ttf wav webm webp woff woff2 xz zip".split()
FOLDERS = "/cgi-bin/ /wp-admin/ /wp-login /wp-json/ /xmlrpc.php /login /signin /signup /register /logout /cart/ /checkout/ /search/ /feed/ /tag/ /trackback/ /ads/ /adserver/ /banners/ /popups/".split()
FALLBACK = (
    *(Rule("block", host_glob=f"*.{x}{end}") for x in LABELS for end in (".*", "-*")),
    *(Rule("block", host_glob=f"*.{x}*") for x in PREFIXES),
    *(Rule("block", x) for x in HOSTS),
    *(Rule("block", path_glob=f"*.{x}") for x in SUFFIXES),
    *(Rule("block", path_glob=f"{x}*") for x in FOLDERS),
)


class Automaton:
    """Shift-And over UTF-8 bytes with ``*`` as self-loops, which PART does not follow; a bit for each literal of each pattern, in multiword masks."""

    def __init__(self, patterns: list[bytes]) -> None:
        literals: list[int] = []
        loops: set[int] = set()
        starts: list[int] = []
        self.ends: list[int] = []
        for body in patterns:
            starts.append(len(literals))
            literals.append(-1)  # the state before the first literal
            if body.startswith(b"*"):
                loops.add(len(literals) - 1)
            for c in body.strip(b"*"):  # a star of its own side within
                if c == 0x2A:
                    loops.add(len(literals) - 1)
                else:
                    literals.append(c)
            if body.endswith(b"*"):
                loops.add(len(literals) - 1)
            self.ends.append(len(literals) - 1)
        self.words = (len(literals) + 63) // 64
        self.masks = np.zeros((256, self.words), np.uint64)
        self.loops = np.zeros((256, self.words), np.uint64)
        self.init = np.zeros(self.words, np.uint64)
        for i, c in enumerate(literals):
            if c >= 0:
                self.masks[c, i // 64] |= np.uint64(1 << (i % 64))
        for i in loops:
            self.loops[:, i // 64] |= np.uint64(1 << (i % 64))
        self.loops[PART[0]] = 0
        for i in starts:
            self.init[i // 64] |= np.uint64(1 << (i % 64))

    def run(self, texts: list[bytes]) -> np.ndarray:
        """A bool for each text and pattern. Memory is that of the texts: they are walked in order of length, as a shrinking block."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, count=n)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        at = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.repeat(self.init[None, :], n, 0)
        live = n
        for step in range(int(lengths[0]) if n else 0):
            while live and lengths[live - 1] <= step:
                live -= 1
            cur = state[:live]
            shifted = cur << np.uint64(1)
            if self.words > 1:
                shifted[:, 1:] |= cur[:, :-1] >> np.uint64(63)
            byte = flat[at[:live] + step]
            state[:live] = (shifted & self.masks[byte]) | (cur & self.loops[byte])
        hit = np.empty((n, len(self.ends)), bool)
        for k, e in enumerate(self.ends):
            hit[order, k] = (state[:, e // 64] >> np.uint64(e % 64)) & np.uint64(1) != 0
        return hit


_UPPER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end].translate(_UPPER), rest[end:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host, path[:end]


def judge(hosts: list[str], paths: list[str], rules: tuple[Rule, ...], fallback: tuple[Rule, ...], automaton: Automaton) -> tuple[list[str | None], list[str]]:
    """The longest stated rule that fits each url, and its verdict; else that of the first fallback rule that fits, else allow."""
    both = (*rules, *fallback)
    hit = automaton.run([b"." + h.encode() + PART + p.encode() for h, p in zip(hosts, paths, strict=True)])
    hit[np.fromiter((not h for h in hosts), bool, count=len(hosts))] = False
    order = sorted(range(len(rules)), key=lambda k: (len(rules[k].name), rules[k].verdict == "block"))
    best = np.full(len(hosts), -1)
    for k in order:
        best[hit[:, k]] = k
    rest = hit[:, len(rules) :]
    other = np.where(rest.any(1), rest.argmax(1) + len(rules), -1) if fallback else np.full(len(hosts), -1)
    names = [rules[k].name if k >= 0 else None for k in best]
    return names, [both[k if k >= 0 else o].verdict if k >= 0 or o >= 0 else "allow" for k, o in zip(best, other, strict=True)]


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, fallback: tuple[Rule, ...] = FALLBACK) -> DataFrame:
    """(id, host, path, rule, verdict) for each row, in one narrow pass.

    Null url or none with ``://``: host and path empty, rule null, verdict allow. A url whose path is empty does not start
    with ``/``. Equal lengths: block wins. Where no stated rule fits, the fallback's names, files and folders are blocked. Repeated rows give repeated results; other columns are not read.
    """
    patterns = [r.pattern for r in (*rules, *fallback)]

    def run(batches):
        automaton = Automaton(patterns)
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            names, verdicts = judge(hosts, paths, rules, fallback, automaton)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    kind = dict(rows.dtypes)["id"]
    return map_arrow(rows, run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _words(x: list[str]) -> str:
    return "'" + " ".join(x) + "'"


#: The fallback in terms of labels, suffixes and folders rather than globs.
OP1_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, '.' || host AS d FROM p),
m AS (SELECT *, CASE
        WHEN host = '' THEN NULL
        WHEN ends_with(d, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN ends_with(d, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN ends_with(d, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN ends_with(d, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN ends_with(d, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM r),
f AS (SELECT *, string_split({_words(LABELS)}, ' ') AS labels, string_split({_words(PREFIXES)}, ' ') AS begins, string_split({_words(HOSTS)}, ' ') AS hosts,
             string_split({_words(SUFFIXES)}, ' ') AS suffixes, string_split({_words(FOLDERS)}, ' ') AS folders FROM m)
SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
        WHEN rule IS NOT NULL THEN 'block'
        WHEN host <> '' AND (
             len(list_filter(labels, lambda x: contains(d, '.' || x || '.') OR contains(d, '.' || x || '-'))) > 0
             OR len(list_filter(begins, lambda x: contains(d, '.' || x))) > 0 OR len(list_filter(hosts, lambda x: ends_with(d, '.' || x))) > 0
             OR len(list_filter(suffixes, lambda x: ends_with(path, '.' || x))) > 0 OR len(list_filter(folders, lambda x: starts_with(path, x))) > 0) THEN 'block'
        ELSE 'allow' END AS verdict
FROM f
"""
