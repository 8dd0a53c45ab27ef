"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams for every other url.

The model is trained on the driver from a small labelled url table (a parameter; the default stands below) and is a
table of 2^16 numbers.  Pages are scored a block at a time, without a shuffle; only the url column is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medfuse.llm import textbytes as tb

BITS = 16
SIZES = (3, 4, 5)
EPOCHS = 60
RATE = 1.0
BLOCK_AT = 0.5

#: Rules as (action, host, path): a rule fits its host and all subdomains where the url's path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Labelled urls that train the default model: what to block, and what to allow.
BLOCK_URLS = """
https://spam-farm.example.net/en/12
http://www.spam-farm.example.com/fr/907
https://cheap-spam.example.com/offers/1
https://link-farm.example.net/seo/backlinks
http://seo-farm.example.com/en/55.html
https://content-farm.example.net/articles/88
https://free-bets.example.com/en/18
http://m.free-bets.example.net/de/7/
https://best-bets.example.com/odds/today
https://sports-bets.example.net/en/301
https://online-casino.example.com/bonus
http://casino-royal.example.net/slots/3
https://free-slots.example.com/spin/99
https://poker-bonus.example.net/en/41
https://jackpot-win.example.com/lottery/5
https://win-prize.example.net/claim/1
https://free-gift.example.com/claim/now
https://cheap-pills.example.com/buy/viagra
http://online-pharmacy.example.net/pills/10
https://diet-pills.example.com/en/77
https://adult-cams.example.net/live/2
http://xxx-videos.example.com/watch/18
https://hot-porn.example.net/en/6
https://sexy-chat.example.com/rooms/1
https://payday-loans.example.com/apply
https://fast-cash.example.net/loan/quick
https://crypto-doubler.example.com/invest
https://free-download.example.net/crack/serial
https://warez-crack.example.com/keygen/4
https://verify-account.example.net/login/secure
""".split()
ALLOW_URLS = """
http://
https://a.com/
http://example.org/
https://www.example.com/
https://user:name@host.example.net:8080/index.html
https://b.example.net/FR/
https://blog.tions.example.net/en/204
http://www.thether.example.com/en/33.html
https://m.therand.example.net/fr/812
https://www.thonre.example.com/en/5/
https://inger.example.net/de/67
http://blog.reand.example.com/es/901
https://news.example.com/world/2021/12
https://www.university.example.net/research/papers/8
https://library.example.com/catalogue/551
https://docs.example.net/guide/install.html
https://wiki.example.com/history/en/19
https://weather.example.net/city/44
https://museum.example.com/en/visit
https://www.hospital.example.net/patients/info
https://travel.example.com/fr/paris/3
https://recipes.example.net/en/soup/120
https://forum.example.com/thread/9034
https://shop.example.net/books/77
https://www.city.example.com/services/water
https://science.example.net/en/physics/6
https://m.ththat.example.com/en/450
https://ondere.example.net/es/71/
http://eshand.example.com/en/9.html
https://blog.entre.example.net/fr/310
https://www.stedon.example.com/en/88
https://orthe.example.net/en/1203
https://m.elleque.example.com/en/15
https://ungkeit.example.net/en/640.html
https://www.ciones.example.com/es/32
https://thering.example.net/en/7/
""".split()


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for NULL and where there is no ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    has = F.coalesce(url.contains("://"), F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, NULL if none does.

    The rules of each host stand in one literal map, longest path first, so a url costs one look-up for each of its
    host's suffixes, however many rules there are.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for action, h, p in rules:
        by_host.setdefault(h, []).append((p, action))
    if not by_host:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    entries = []
    for h, found in by_host.items():
        own = [F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(a).alias("action"))
               for p, a in sorted(found)]
        entries += [F.lit(h), F.array(*own)]
    table = F.create_map(*entries)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast(
        "array<struct<size:int,rule:string,path:string,action:string>>")))), lambda r: path.startswith(r["path"]))
    best = F.array_max(fits)
    return best["rule"], best["action"]


@dataclass
class Model:
    table: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of ``block`` for each row of a block."""
        buckets, rows = features(data, offsets)
        n = len(offsets) - 1
        sums = np.bincount(rows, weights=self.table[buckets], minlength=n)
        sizes = np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))
        return np.round(1 / (1 + np.exp(-np.clip(sums / sizes + self.bias, -30, 30))), 9)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, rows) of the n-grams of each row; digits are alike, so numbers in paths do not matter."""
    text = np.where((data >= 0x30) & (data <= 0x39), np.uint8(0x30), data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    buckets, rows = [], []
    for n in SIZES:
        codes = tb.grams(text, n, BITS, salt=9)
        inside = row[:len(codes)] == row[n - 1:] if len(codes) else np.zeros(0, bool)
        buckets.append(codes[inside])
        rows.append(row[:len(codes)][inside])
    return np.concatenate(buckets), np.concatenate(rows)


def _line(host: str, path: str) -> str:
    return f"^{host} {path}$"


def train(urls: list[str], blocked: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> Model:
    lines = []
    for url in urls:
        rest = url.split("://", 1)[1]
        host, slash, path = rest.partition("/")
        lines.append(_line(host.lower(), slash + path))
    data, offsets = tb.column_bytes(pa.array(lines, pa.large_string()))
    buckets, rows = features(data, offsets)
    table, bias, rng = np.zeros(1 << BITS), 0.0, np.random.default_rng(seed)
    each = [np.unique(buckets[rows == i], return_counts=True) for i in range(len(lines))]
    for epoch in range(epochs):
        for i in rng.permutation(len(lines)):
            kinds, counts = each[i]
            x = counts / np.sqrt(max(1, counts.sum()))
            error = 1 / (1 + np.exp(-np.clip(x @ table[kinds] + bias, -30, 30))) - blocked[i]
            table[kinds] -= rate / (1 + epoch / 10) * (error * x + 1e-4 * table[kinds])
            bias -= 0.1 * rate / (1 + epoch / 10) * error
    return Model(table, float(bias))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, block_urls: list[str] | None = None,
          allow_urls: list[str] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row.

    ``verdict``: the action of the longest rule that fits, else ``block`` where the model's probability (``score``) is 0.5 or
    more.  A NULL or empty url, or one without ``://``, has an empty host and path; no rule fits it and the
    model judges the empty text.  Repeated rows get equal results; an empty table gives an empty result; other columns are not read.
    """
    bad, good = BLOCK_URLS if block_urls is None else block_urls, ALLOW_URLS if allow_urls is None else allow_urls
    shared = pages.sparkSession.sparkContext.broadcast(train(bad + good, [1] * len(bad) + [0] * len(good)))     # 2^BITS numbers
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    given = parts.select("*", F.concat(F.lit("^"), "host", F.lit(" "), "path", F.lit("$")).alias("line"))
    kind = given.schema["page_id"].dataType.simpleString()

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [model.score(data, offsets) for _, _, data, offsets in tb.blocks(batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                                             ["page_id", "host", "path", "score"])

    scored = given.mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), "score").select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"), "score")
