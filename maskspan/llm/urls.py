"""URL filter: a trie over reversed host labels and path segments with longest-match precedence.

An entry is a host, matching it and all its subdomains, or a host and a path, matching it and everything below it.  The trie's
edges are (node, label) pairs; the labels of "a.example.com/x/y" are com, example, a, a mark that the host ends, x, y.  All URLs
of a batch walk the trie together, one label a step, by binary search in the sorted edges, and remember the last entry passed:
the longest match decides.  An entry with a path is longer than any entry of its host; of an allow and a block entry for the same place the
allow entry wins; a URL that no entry matches is allowed.

URLs: the scheme, user, port, query and fragment are ignored; hosts and paths are compared in lower case, a trailing dot or slash and
doubled slashes are ignored, "www." is a label like any other.

Defined results: a null URL, an empty one and one without a host get the verdict "invalid"; a very long one is walked as far as
the trie goes; repeated rows get equal verdicts; null or hostless entries match nothing; every row is kept, also without page_id;
columns other than page_id and url are ignored; an empty table gives no rows, an empty list allows all valid URLs.

Scale: one narrow pass over two columns, no shuffle.  The entries' size is checked: up to TRIE_BYTES they travel as one trie with the tasks;
a longer list is joined instead on hashes of every prefix that a URL has (classify() picks).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIE_BYTES = 64 << 20
#: (entry, action): the default list.
ENTRIES = [
    ("casino-win.example.com", "block"),
    ("free-bets.example.com", "block"),
    ("cheap-pills.example.com", "block"),
    ("ads-track.example.com", "block"),
    ("ads-track.example.com/en", "allow"),
    ("free-bets.example.com/de", "allow"),
    ("example.net", "block"),
    ("example.net/en", "allow"),
    ("blog.example.net", "allow"),
    ("tionsh.example.com", "block"),
    ("blog.tionsh.example.com", "allow"),
    ("blog.tionsh.example.com/fr", "block"),
]

_HOST = r"^(?i:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^(?i:[a-z][a-z0-9+.\-]*:)?//[^/?#]*([^?#]*)"
_ROOT = "\x00"


def split_entry(entry: str | None) -> list[str]:
    """The labels of an entry, or none if it has no host."""
    if not entry:
        return []
    host, _, path = entry.strip().lower().partition("/")
    labels = [x for x in host.rstrip(".").split(".")[::-1]]
    if not host.strip(".") or "" in labels:
        return []
    segments = [x for x in path.split("/") if x]
    return [*labels, _ROOT, *segments] if segments else labels


class Trie:
    def __init__(self, entries: list[tuple[str, str]]):
        nodes: dict[tuple[int, str], int] = {}
        action: dict[int, tuple[str, str]] = {}
        for entry, verdict in entries:
            labels = split_entry(entry)
            if not labels or verdict not in ("allow", "block"):
                continue
            at = 0
            for label in labels:
                at = nodes.setdefault((at, label), len(nodes) + 1)
            if action.get(at, ("", ""))[0] != "allow":
                action[at] = (verdict, "/".join([".".join(labels[: labels.index(_ROOT)][::-1]), *labels[labels.index(_ROOT) + 1 :]]) if _ROOT in labels else ".".join(labels[::-1]))
        self.labels = pa.array(sorted({x for _, x in nodes}), pa.string())
        number = {x: k for k, x in enumerate(self.labels.to_pylist())}
        size = max(1, len(number))
        edge = np.array([p * size + number[x] for p, x in nodes], np.int64)
        order = np.argsort(edge)
        self.size = size
        self.edge = edge[order]
        self.child = np.array(list(nodes.values()), np.int64)[order]
        self.root = number.get(_ROOT, -1)
        top = len(nodes) + 1
        self.verdict = np.zeros(top, np.int8)
        self.entry = np.full(top, None, object)
        for at, (verdict, text) in action.items():
            self.verdict[at] = 1 if verdict == "allow" else 2
            self.entry[at] = text

    def step(self, node: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child by a label, -1 where there is none."""
        if not len(self.edge):
            return np.full(len(node), -1)
        key = node * self.size + label
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where((node >= 0) & (label >= 0) & (self.edge[at] == key), self.child[at], -1)

    def classify(self, urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(verdict 0 invalid, 1 allow, 2 block; matched entry or None) of each URL."""
        urls = urls.cast(pa.string())
        host, path = parts(urls)
        valid = pc.fill_null(pc.greater(pc.utf8_length(host), 0), False).to_numpy(zero_copy_only=False)
        node, last = np.where(valid, 0, -1), np.zeros(len(urls), np.int64)
        for column, reverse in ((host, True), (path, False)):
            lists = pc.split_pattern(pc.fill_null(column, ""), "." if reverse else "/")
            ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.labels), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.append(0, np.cumsum(np.array(lists.value_lengths())))
            if not reverse:
                # into the paths of the host: only from the node of the whole host
                node = self.step(node, np.full(len(node), self.root))
            at = ends[1:] - 1 if reverse else ends[:-1]
            live = np.flatnonzero((node >= 0) & (pc.fill_null(pc.greater(pc.utf8_length(column), 0), False).to_numpy(zero_copy_only=False)))
            k = 0
            while len(live):
                spot = at[live] + (-k if reverse else k)
                inside = (spot >= ends[live]) & (spot < ends[live + 1])
                if not inside.all():
                    live, spot = live[inside], spot[inside]
                to = self.step(node[live], ids[spot])
                ended = to < 0
                if reverse or ended.any():
                    node[live[ended]] = -1
                live, to = live[~ended], to[~ended]
                node[live] = to
                hit = self.verdict[to] > 0
                last[live[hit]] = to[hit]
                k += 1
            # after the host's labels, node is -1 for those that left the trie and the host's node for the rest
        verdict = np.where(valid, np.where(last > 0, self.verdict[last], 1), 0)
        return verdict, self.entry[last]


def parts(urls: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(host, path) in lower case, the path without slashes at its ends or doubled ones; null without a host."""
    host = pc.struct_field(pc.extract_regex(urls, _HOST.replace("([^/?#:]*)", "(?P<h>[^/?#:]*)")), "h")
    path = pc.struct_field(pc.extract_regex(urls, _PATH.replace("([^?#]*)", "(?P<p>[^?#]*)")), "p")
    host = pc.utf8_rtrim(pc.utf8_lower(host), ".")
    path = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(path), "/+", "/"), "/")
    return host, path


_ready: dict[str, Trie] = {}


def _classify(entries: list[tuple[str, str]]):
    import hashlib

    key = hashlib.sha1(repr(entries).encode()).hexdigest()

    def run(batches):
        if key not in _ready:
            _ready.clear()
            _ready[key] = Trie(entries)
        trie = _ready[key]
        names = np.array(["invalid", "allow", "block"], object)
        for batch in batches:
            verdict, entry = trie.classify(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[verdict].tolist(), pa.string()), pa.array(entry.tolist(), pa.string())], names=["page_id", "url", "verdict", "entry"])

    return run


def classify(pages: DataFrame, entries: DataFrame | None = None, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(page_id, url, verdict, entry): allow, block or invalid, and the entry that decided.  entries: (entry, action)."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    if entries is None:
        items = ENTRIES
    else:
        clean = entries.select(F.col("entry").cast("string").alias("entry"), F.col("action").cast("string").alias("action")).where("entry is not null and action in ('allow', 'block')")
        if (clean.agg(F.sum(F.octet_length("entry") + 32)).first()[0] or 0) > trie_bytes:
            return _by_join(spark, rows, clean)
        items = [tuple(r) for r in clean.collect()]
    return rows.mapInArrow(_classify(items), "page_id bigint, url string, verdict string, entry string")


def _normal(host, path):
    return F.when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))


def _by_join(spark: SparkSession, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The same verdicts for a list of any size: every URL's host suffixes and path prefixes are joined with the entries."""
    host_of = lambda c: F.rtrim(F.lower(c), F.lit("."))
    path_of = lambda c: F.trim(F.regexp_replace(F.lower(c), "/+", "/"), F.lit("/"))
    e = F.lower(F.trim("entry"))
    e_host, e_path = host_of(F.substring_index(e, "/", 1)), path_of(F.regexp_replace(e, "^[^/]*", ""))
    list_ = entries.where((F.length(e_host) > 0) & ~e_host.rlike(r"^\.|\.\.")).select(_normal(e_host, e_path).alias("entry"), "action").groupBy("entry").agg(F.min("action").alias("action"))
    keyed = rows.withColumn("host", host_of(F.regexp_extract("url", _HOST, 1))).withColumn("path", path_of(F.regexp_extract("url", _PATH, 1)))
    urls = keyed.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(k.alias("n"), F.lit(0).alias("m"), F.array_join(F.slice(labels, -k, k), ".").alias("entry")))
    segments = F.split("path", "/")
    prefixes = F.when(F.col("path") == "", F.array().cast("array<struct<n:int,m:int,entry:string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.struct(F.size(labels).alias("n"), k.alias("m"), F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice(segments, 1, k), "/")).alias("entry"))))
    tried = urls.select("host", "path", F.explode(F.concat(suffixes, prefixes)).alias("x")).select("host", "path", "x.*")
    won = tried.join(list_, "entry").groupBy("host", "path").agg(F.max_by(F.struct("action", "entry"), F.struct("n", "m")).alias("best"))
    out = keyed.join(won.withColumnsRenamed({"host": "won_host", "path": "won_path"}), (F.col("host") == F.col("won_host")) & (F.col("path") == F.col("won_path")), "left")
    verdict = F.when(F.coalesce("host", F.lit("")) == "", "invalid").otherwise(F.coalesce("best.action", F.lit("allow")))
    return out.select("page_id", "url", verdict.alias("verdict"), F.col("best.entry").alias("entry"))


def sql(entries: list[tuple[str, str]] = ENTRIES) -> str:
    """DuckDB: the longest matching entry of each page."""
    values = ", ".join(f"('{e}', '{a}')" for e, a in entries)
    return f"""
WITH entries(entry, action) AS (VALUES {values}),
e AS (SELECT entry, action, split_part(entry, '/', 1) AS host, CASE WHEN contains(entry, '/') THEN substr(entry, strpos(entry, '/') + 1) ELSE '' END AS path FROM entries),
u AS (SELECT page_id, url, row_number() OVER () AS k,
  rtrim(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
  trim(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)), '/+', '/', 'g'), '/') AS path FROM pages),
m AS (SELECT u.k, e.entry, e.action, row_number() OVER (PARTITION BY u.k ORDER BY length(e.host) DESC, length(e.path) DESC, e.action) AS r
  FROM u JOIN e ON (e.path = '' AND (u.host = e.host OR ends_with(u.host, '.' || e.host)))
    OR (e.path <> '' AND u.host = e.host AND (u.path = e.path OR starts_with(u.path, e.path || '/'))))
SELECT u.page_id, u.url, CASE WHEN coalesce(u.host, '') = '' THEN 'invalid' ELSE coalesce(m.action, 'allow') END AS verdict, m.entry
FROM u LEFT JOIN m ON m.k = u.k AND m.r = 1"""
