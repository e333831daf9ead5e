"""URL filters: longest matching rule, else a logistic regression on hashed character n-grams of host and path.

A url's host is what follows its first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its
path goes on up to ``?``, ``#`` or the end.  A rule names a host, which stands for its subdomains too, and the
beginning of a path.  Of all rules that fit, the longest decides (ties: that of the longest host).

Urls without a rule are scored.  Features are the runs of 3 to 5 code points of host and path, each with a
mark at both ends and all digits alike, hashed with their part and length into 2 ** BITS rows; a url's features weigh
1 / sqrt(how many it has).  The model is fitted on a small labelled table, at most ``MOST_LABELLED`` urls (more are
refused, not cut), so its size is fixed and it goes to every task.  Scoring is one map pass without a shuffle, whatever
host is the commonest; a batch's urls are worked on ``CHUNK`` code points at a time, a longer url alone.

Edge cases: a null url or one without ``://`` has an empty host and path; no rule fits an empty host, and it
is scored by its end marks alone.  Repeated rows and null ids are judged like any other; an empty table gives no rows;
other columns of the table aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.shared import table
from tessel.llm.text import mix64

#: The rules that the query applies (fixed values).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

SIZES, BITS = (3, 4, 5), 17
CHUNK = 1 << 18
MOST_LABELLED = 10_000
STEPS, RATE, DECAY, BLOCK_AT = 400, 4.0, 1e-4, 0.5

#: The small labelled table: words of hosts to block and to allow.  Each makes urls of its own on every top-level
#: domain and in every language, so that neither tells the labels apart.
BLOCKED = "casino-royal best-casino win-big free-bets bets-online poker-win slots-jackpot cheap-pills pills-online cheap-meds viagra-shop diet-pills payday-loans fast-loans spam-farm link-farm content-farm seo-links buy-followers free-prizes win-prizes adult-cams hot-singles xxx-videos porn-tube crack-keygen warez-free torrent-free replica-watches cheap-watches crypto-doubler get-rich".split()
ALLOWED = "library archive gardening recipes university museum weather history physics chemistry travel-notes cooking-class local-news city-council parliament school-board music-review bookshop film-journal open-data bird-watching mountain-club chess-club river-trust health-service science-daily thinking theatre sharing nation station winter therapy northern the-other thing interest weather-report bakery orchestra painting sailing training reading writing swimming railway kitchen cathedral harbour institute engineering translation".split()


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url column; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class Rules:
    """Rules by host; looked up for the suffixes of a host that have as many labels as any rule."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, host + path, verdict))
        self.labels = max((host.count(".") + 1 for host in self.by_host), default=0)

    def of_host(self, host: str) -> list[tuple[str, str, str]]:
        """(path, rule, verdict) for a host, the longest rule first."""
        parts = host.rsplit(".", self.labels)
        tails = [".".join(parts[-k:]) for k in range(len(parts), 0, -1)]
        fits = [(path, rule, verdict) for tail in tails if tail for path, rule, verdict in self.by_host.get(tail, ())]
        return sorted(fits, key=lambda x: (-len(x[1]), len(x[0])))

    def judged(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | tuple[None, None]]:
        known: dict[str, list[tuple[str, str, str]]] = {}
        out: list[tuple[str, str] | tuple[None, None]] = []
        for host, path in zip(hosts, paths):
            if host not in known:
                known[host] = self.of_host(host)
            out.append(next(((rule, verdict) for start, rule, verdict in known[host] if path.startswith(start)), (None, None)))
        return out


_DIGITS = np.arange(48, 58, dtype=np.uint32)
_HOST, _PATH, _END = "\x02", "\x03", "\x04"


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, url) of every n-gram of some urls; rows below 2 ** BITS, urls ascending within each size."""
    marked = [f"{_HOST}{h}{_END}{_PATH}{p}{_END}" for h, p in zip(hosts, paths)]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((points >= _DIGITS[0]) & (points <= _DIGITS[-1]), _DIGITS[0], points).astype(np.uint64)
    lengths = np.array([len(m) for m in marked], np.int64)
    url = np.repeat(np.arange(len(marked)), lengths)
    place = np.arange(len(points))
    first = np.cumsum(lengths) - lengths
    part = place - first[url] >= np.array([len(h) + 2 for h in hosts], np.int64)[url]  # in the path
    rows, owners = [], []
    for size in SIZES:
        n = len(points) - size + 1
        if n <= 0:
            continue
        inside = (url[:n] == url[size - 1 :]) & (part[:n] == part[size - 1 :])
        sums = np.zeros(n, np.uint64)
        for k in range(size):
            sums = sums * np.uint64(0x100000001B3) + points[k : k + n]
        mixed = mix64(sums + np.uint64(size << 56) + part[:n].astype(np.uint64) * np.uint64(1 << 62))
        rows.append((mixed[inside] >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(url[:n][inside])
    return (np.concatenate(rows), np.concatenate(owners)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that a url is one to block."""
        out, at = np.zeros(len(hosts)), 0
        while at < len(hosts):
            to, size = at, 0
            while to < len(hosts) and (to == at or size + len(hosts[to]) + len(paths[to]) <= CHUNK):
                size += len(hosts[to]) + len(paths[to]) + 4
                to += 1
            rows, url = features(hosts[at:to], paths[at:to])
            held = np.bincount(url, minlength=to - at)
            sums = np.bincount(url, self.weights[rows], minlength=to - at) / np.sqrt(np.maximum(1, held))
            out[at:to] = 1 / (1 + np.exp(-(sums + self.bias)))
            at = to
        return out


def train(labelled: list[tuple[str, str, int]]) -> Model:
    """Logistic regression by full gradient steps on (host, path, 1: block) of a small table."""
    if len(labelled) > MOST_LABELLED:
        raise ValueError(f"{len(labelled)} labelled urls; {MOST_LABELLED} at most")
    rows, url = features([x[0] for x in labelled], [x[1] for x in labelled])
    used, rows = np.unique(rows, return_inverse=True)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(url, minlength=len(labelled))))[url]
    target = np.array([float(x[2]) for x in labelled])
    weights, bias = np.zeros(len(used)), 0.0
    for _ in range(STEPS if len(labelled) else 0):
        miss = 1 / (1 + np.exp(-(np.bincount(url, weights[rows] * scale, minlength=len(target)) + bias))) - target
        slope = np.bincount(rows, miss[url] * scale, minlength=len(used)) / len(target)
        weights -= RATE * len(SIZES) * (slope + DECAY * weights)
        bias -= RATE / 4 * miss.mean()
    full = np.zeros(1 << BITS)
    full[used] = weights
    return Model(full, bias)


def labelled_table() -> list[tuple[str, str, int]]:
    """The small labelled table: every word on all of its hosts and paths."""
    hosts = ["{}.example.com", "www.{}.example.org", "blog.{}.example.net", "m.{}.example.org", "{}.org", "www.{}.com"]
    paths = ["/en/1", "/de/20/", "/fr/300.html", "/es/4"]
    return [(host.format(word), paths[(n + k) % len(paths)], label) for label, words in ((1, BLOCKED), (0, ALLOWED)) for n, word in enumerate(words) for k, host in enumerate(hosts)]


def judged(pages: DataFrame, key: str, url: str, rules: list[tuple[str, str, str]], model: Model) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every row; ``score`` is the model's, whoever decides."""
    host, path = parsed(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    kind, by = rows.schema["key"].dataType.simpleString(), Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found, scores = by.judged(hosts, paths), model.scores(hosts, paths)
            verdicts = [verdict or ("block" if score >= BLOCK_AT else "allow") for (_, verdict), score in zip(found, scores)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([rule for rule, _ in found], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores)], names=["key", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("key", key)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), "page_id", "url", RULES, train(labelled_table()))
