"""Main text of web pages: blocks of page structure, then a suffix array over each host's token streams.

A page becomes blocks of text, each inside or outside an article. What an element itself means (menu, header, footer,
aside, form, script, style) or a role or one whole word of its class says is left out; a class of the layout (sidebar,
notice) doesn't leave out an article in such an element, and none leaves out html, body or main. The words of all remaining
blocks are the page's two token streams, of what is inside and what is outside an article; all streams of a host, page
after page, make one text whose suffixes are sorted. Neighbours in the suffix array that share ``depth`` or more tokens
(their longest common prefix) are a repeated substring. It is boilerplate outside articles if ``least_pages`` distinct
pages hold it there, and inside an article if more than ``article_share`` of the host's pages hold it anywhere. Covered
words are removed and the unique runs kept. A page with an article keeps its blocks inside it only.

A host of at most ``group_bytes`` of html is one group with one suffix array, whose size is so bounded. For a larger
host the same substrings are counted without moving its pages: substrings of ``depth`` tokens are hashed (64 bits).
Those outside articles are summed up by hash. For the rest, a part of the pages yields only substrings that more than
half the needed share of its own pages hold; where no page has copies in many parts, what no part yields is too rare
everywhere, and what the sums leave possible is counted exactly over the whole host; where pages have, all is. So the rule is the same for every size, and a host with a third of
all pages is spread over all tasks. Equal streams count as one page, so copies of a page don't make its own text
boilerplate.

Edge cases: null or empty html gives empty text; a null url is a host of its own; html that is cut short ends in what it
has; a tag or comment that never ends hides the rest; repeated rows come back as often; null ids are carried; a very
long page is one stream like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, materialize

# Names of HTML elements and the words that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title svg math object select".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("head nav header footer aside form button dialog menu".split())
ARTICLE = frozenset("article main".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
SKIP_WORDS = frozenset("ad ads advert advertisement sponsored banner cookie consent notice alert popup newsletter sidebar nav navbar menu breadcrumbs header footer comment comments replies".split())
COMMENT_WORDS = frozenset("comment comments replies ad ads advert advertisement sponsored".split())

MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _skips(name: str, attributes: str) -> int:
    """2 if an element and all in it is left out, 1 if only what isn't in an article there, 0 if it stays."""
    if name in SKIPPED:
        return 2
    if not attributes or attributes.isspace():
        return 0
    found = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")):
        return 2
    if found.get("role") in SKIP_ROLES:
        return 2
    words = {*found.get("class", "").split(), *found.get("id", "").split()}
    if name in ("body", "html", "main"):
        return 0
    if words & COMMENT_WORDS:
        return 2
    return int(name not in ARTICLE and bool(words & SKIP_WORDS))


def page_blocks(source: str | None) -> list[tuple[str, bool]]:
    """(text, inside an article) of each block that isn't left out, in page order."""
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, whether it is skipped (_skips), in an article
    parts: list[str] = []
    source = source or ""

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, stack[-1][2]))

    at = 0
    while at < len(source):
        m = MARK.search(source, at)
        begin = m.start() if m else len(source)
        if begin > at and not stack[-1][1]:
            parts.append(source[at:begin])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1] or m[4] or "") == "/", m[3] or m[6] or ""
        if name == "br" or name in VOID:
            if not stack[-1][1]:
                flush() if name == "hr" else parts.append(" ")
            continue
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if name in BLOCKS:
            flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in BLOCKS and name != "p" or name == "p":
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                if stack[k][0] == "p" and name in BLOCKS:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    if stack[k][0] == name and name in ("li", "dd", "dt", "td", "th", "tr"):
                        del stack[k:]
                    break
        _, skipped, inside = stack[-1]
        if skipped == 1 and name in ARTICLE:
            skipped = 0
        stack.append((name, max(skipped, _skips(name, attributes)), inside or name in ARTICLE))
    flush()
    return out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``tokens`` in order, and the longest common prefix of each with the one before it.

    Prefix doubling until all suffixes differ; the ranks of each step, longest first, then give the common prefixes.
    """
    n = len(tokens)
    rank, size = np.unique(tokens, return_inverse=True)[1].astype(np.int32), 1
    steps = [rank]
    while n and int(rank.max()) + 1 < n:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - size] += rank[size:].astype(np.int64) + 1
        rank, size = np.unique(key, return_inverse=True)[1].astype(np.int32), 2 * size
        steps.append(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    common = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(steps) - 1, -1, -1):
        a, b = order[:-1] + common, order[1:] + common
        at = np.flatnonzero((a < n) & (b < n))
        common[at[steps[k][a[at]] == steps[k][b[at]]]] += 1 << k
    return order, np.concatenate([[0], common])[:n]


def page_counts(tokens: np.ndarray, page: np.ndarray, counted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position, how many distinct pages hold the ``depth`` tokens from there on, and how many at a ``counted`` one.

    ``tokens`` must end each stream with a separator that occurs once, so no common prefix reaches over an end.
    """
    order, common = suffix_array(tokens)
    group = np.cumsum(common < depth) - 1  # suffixes with the same first tokens stand together
    pages = np.int64(page.max() + 1) if len(page) else 1
    both = []
    for own in (np.ones(len(tokens), bool), counted):
        at = own[order]
        held = np.unique(group[at] * pages + page[order][at]) // pages
        out = np.empty(len(tokens), np.int64)
        out[order] = np.bincount(held, minlength=len(tokens))[group]
        both.append(out)
    return both[0], both[1]


def covered(begins: np.ndarray, depth: int) -> np.ndarray:
    """Positions inside a run of ``depth`` tokens that begins where ``begins`` is true."""
    marks = np.zeros(len(begins) + 1, np.int64)
    at = np.flatnonzero(begins)
    np.add.at(marks, at, 1)
    np.add.at(marks, np.minimum(at + depth, len(begins)), -1)
    return np.cumsum(marks)[:-1] > 0


def long_enough(gone: np.ndarray, depth: int) -> np.ndarray:
    """Covered runs of a block that are as long as a substring; shorter ones only reach in from the next block."""
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    out = np.zeros_like(gone)
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        out[a:b] = b - a >= depth
    return out


def least_inside(pages: int, least_pages: int, article_share: float) -> int:
    """A limit for what is inside articles that counts for hosts of a few pages too."""
    return max(5, least_pages, int(article_share * pages) + 1)


def stream(blocks: list[tuple[str, bool]], inside: bool) -> list[str]:
    """The words of the blocks inside an article, or of the others."""
    return [w for text, i in blocks if i == inside for w in text.split(" ")]


def unique_text(blocks: list[tuple[str, bool]], gone: tuple[np.ndarray, np.ndarray], depth: int) -> str:
    """The text of a page without the words that are covered outside (``gone[0]``) or inside (``gone[1]``) articles."""
    own, article, at = [], any(i for _, i in blocks), [0, 0]
    for text, inside in blocks:
        words = text.split(" ")
        own_gone = gone[inside][at[inside] : at[inside] + len(words)]
        at[inside] += len(words)
        if article and not inside:
            continue
        if own_gone.any() and not own_gone.all():
            own_gone = long_enough(own_gone, depth)
        if own_gone.any():
            text = " ".join(w for w, g in zip(words, own_gone, strict=True) if not g)
        if text:
            own.append(text)
    return "\n\n".join(own)


def extract_group(sources: list[str | None], depth: int, least_pages: int, article_share: float) -> list[str]:
    """The main text of each page of a host, by one suffix array."""
    pages = [page_blocks(s) for s in sources]
    known: dict[str, int] = {}
    streams: dict[tuple, tuple[int, int, int]] = {}  # blocks: where both streams begin, and the end
    tokens: list[int] = []
    page: list[int] = []
    outside: list[bool] = []
    for blocks in pages:
        key = tuple(blocks)
        if not blocks or key in streams:
            continue
        at = []
        for inside in (False, True):
            at.append(len(tokens))
            tokens += [known.setdefault(w, len(known)) for w in stream(blocks, inside)]
            tokens.append(-1 - len(tokens))
            outside += [not inside] * (len(tokens) - len(outside))
        page += [len(streams)] * (len(tokens) - len(page))
        streams[key] = (*at, len(tokens))
    anywhere, there = page_counts(np.array(tokens, np.int64), np.array(page, np.int64), np.array(outside, bool), depth)
    least = least_inside(len(streams), least_pages, article_share)
    texts = {key: unique_text(list(key), (covered(there[a:b] >= least_pages, depth), covered(anywhere[b:end] >= least, depth)), depth) for key, (a, b, end) in streams.items()}
    return [texts[tuple(b)] if b else "" for b in pages]


class RunHasher:
    """64-bit hashes of ``depth`` words in a row, from the words' own hashes."""

    MOST_WORDS = 400_000

    def __init__(self, depth: int):
        rng = np.random.default_rng(11)
        self.depth, self.odd = depth, rng.integers(0, 2**64, depth, np.uint64) | np.uint64(1)
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str], salt: int) -> np.ndarray:
        """One hash for each position with ``depth`` words from there on; ``salt`` parts hosts and streams."""
        import xxhash

        if len(words) < self.depth:
            return np.empty(0, np.int64)
        if len(self.known) > self.MOST_WORDS:
            self.known.clear()
        known, h = self.known, xxhash.xxh64_intdigest
        each = np.array([known[w] if w in known else known.setdefault(w, h(w)) for w in words], np.uint64)
        n = len(words) - self.depth + 1
        out = np.full(n, salt, np.uint64)
        for k, odd in enumerate(self.odd):
            out += (each[k : k + n] ^ (each[k : k + n] >> np.uint64(29))) * odd
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return (out ^ (out >> np.uint64(29))).view(np.int64)


def page_keys(host: str, blocks: list[tuple[str, bool]]) -> tuple[int, int]:
    """Hashes of the host and of a page's blocks on that host; equal pages of a host have one hash."""
    import xxhash

    h = xxhash.xxh64_intdigest(host)
    return h, xxhash.xxh64_intdigest(repr(blocks), h) - 2**63


class LocalCounts:
    """How many of a part's distinct pages hold each substring, for each host; of bounded size.

    A part is what is held at once. It yields (host, run, its pages with the run, its pages) for runs that more than
    ``share`` of its pages hold, and (host, null, 0, its pages) for each host.
    """

    MOST_RUNS, FEW_PAGES = 2_000_000, 8

    def __init__(self, share: float):
        self.share, self.size = share, 0
        self.held: dict[int, list[np.ndarray]] = {}

    def add(self, host: int, runs: np.ndarray) -> list[tuple]:
        self.held.setdefault(host, []).append(runs)
        self.size += len(runs) + 1
        return self.yielded() if self.size > self.MOST_RUNS else []

    def yielded(self, all_hosts: bool = False) -> list[tuple]:
        many = [h for h, pages in self.held.items() if len(pages) > self.FEW_PAGES]
        few = sum(len(r) + 1 for h, pages in self.held.items() if len(pages) <= self.FEW_PAGES for r in pages)
        out = []
        for h in list(self.held) if all_hosts or 2 * few > self.MOST_RUNS else many:
            pages = self.held.pop(h)
            self.size -= sum(len(r) + 1 for r in pages)
            runs, n = np.unique(np.concatenate(pages), return_counts=True)
            often = n > self.share * len(pages)
            out.append((h, None, 0, len(pages)))
            out += [(h, r, c, len(pages)) for r, c in zip(runs[often].tolist(), n[often].tolist(), strict=True)]
        return out


#: Runs that are sent to every task at once; more are found by a join.
MOST_SENT = 500_000


def extract_large(pages: DataFrame, depth: int, least_pages: int, article_share: float) -> DataFrame:
    """What ``extract_group`` gives, for hosts of any size: ``pages`` are page_id, url, html, host.

    Three passes over the pages, of which none moves them: one marks what may repeat, one counts what may be boilerplate
    inside articles (only where there is such), and one removes what is. What goes between them is hashes.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    block = pa.list_(pa.struct([("text", pa.string()), ("inside", pa.bool_())]))
    part_share = article_share / 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield batch.slice(at, SLICE_ROWS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """host, page, run, seen, pages. With ``page`` set: a page (run null), or a run outside its article, where seen
        is 1 if the page has none. Without: what ``LocalCounts`` yields."""
        runs_of, local, seen = RunHasher(depth), LocalCounts(part_share), set()
        schema = pa.schema([(n, pa.int64()) for n in ("host", "page", "run", "seen", "pages")])

        def table(found: list[tuple]) -> list[pa.RecordBatch]:
            return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)] if found else []

        for part in rows(batches):
            found = []
            for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                blocks = page_blocks(source)
                h, page = page_keys(host, blocks)
                if not blocks or page in seen:
                    continue
                seen.add(page)
                own = h - 2**63
                found.append((own, page, None, 0, 0))
                lone = int(not any(i for _, i in blocks))
                outside = runs_of(stream(blocks, False), h)
                found += [(own, page, r, lone, 0) for r in np.unique(outside).tolist()]
                found += [(a, None, r, c, n) for a, r, c, n in local.add(own, np.unique(np.concatenate([outside, runs_of(stream(blocks, True), h)])))]
            yield from table(found)
        yield from table([(a, None, r, c, n) for a, r, c, n in local.yielded(all_hosts=True)])

    def listed(sent: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """host, page, run: a page's runs, of those ``sent`` or of all; once for each page of a task."""
            runs_of, seen = RunHasher(depth), set()
            for part in rows(batches):
                hosts, keys, found = [], [], [np.empty(0, np.int64)]
                for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    blocks = page_blocks(source)
                    h, page = page_keys(host, blocks)
                    if page in seen:
                        continue
                    seen.add(page)
                    own = np.unique(np.concatenate([runs_of(stream(blocks, inside), h) for inside in (False, True)]))
                    if sent is not None and len(own):
                        own = own[sent[np.minimum(np.searchsorted(sent, own), len(sent) - 1)] == own]
                    hosts += [h - 2**63] * len(own)
                    keys += [page] * len(own)
                    found.append(own)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.concatenate(found))], names=["host", "page", "run"])

        return run

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches):
            blocks = [page_blocks(s) for s in part.column(2).to_pylist()]
            keys = [page_keys(h, b)[1] for h, b in zip(part.column(3).to_pylist(), blocks, strict=True)]
            listed = pa.array([[{"text": t, "inside": i} for t, i in b] for b in blocks], block)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(keys, pa.int64()), listed], names=["page_id", "url", "host", "page", "blocks"])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of = RunHasher(depth)
        for part in rows(batches):
            texts = []
            for host, found, *held in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4), part.column(5), strict=True):
                blocks = [(b["text"], b["inside"]) for b in found]
                h = page_keys(host, [])[0]
                gone = []
                for inside in (False, True):
                    words = stream(blocks, inside)
                    begins = np.zeros(len(words), bool)
                    if held[inside].is_valid and len(held[inside]) and len(words) >= depth:
                        begins[: len(words) - depth + 1] = np.isin(runs_of(words, h), held[inside].values.to_numpy())
                    gone.append(covered(begins, depth))
                texts.append(unique_text(blocks, tuple(gone), depth))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    html_of = pages.select("host", "html")
    marks = materialize(html_of.mapInArrow(mark, "host long, page long, run long, seen long, pages long"), "marks")
    number = materialize(marks.where("page IS NOT NULL AND run IS NULL").select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n")), "pages")
    # outside: every distinct page counts
    outside = marks.where("page IS NOT NULL AND run IS NOT NULL").groupBy("page", "run").agg(F.max("seen").alias("lone"))
    often = materialize(outside.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("lone").alias("lone")).where((F.col("n") >= least_pages) & (F.col("lone") == 1)).select("run"), "often")
    held = outside.where("lone = 1").select("page", "run").join(often, "run", "left_semi").withColumn("inside", F.lit(False))
    # inside: what the parts leave possible
    local = marks.where("page IS NULL")
    parts = local.where("run IS NULL").groupBy("host").agg(F.sum("pages").alias("all"))
    least = F.greatest(F.lit(max(5, least_pages)), F.floor(article_share * F.col("n")) + 1)
    limits = materialize(number.join(parts, "host").select("host", "all", least.alias("least"), (part_share * F.col("all") >= least).alias("copied")), "limits")
    sums = local.where("run IS NOT NULL").groupBy("host", "run").agg(F.sum("seen").alias("seen"), F.sum("pages").alias("pages"))
    possible = materialize(sums.join(limits.where("NOT copied"), "host").where(F.col("seen") + part_share * (F.col("all") - F.col("pages")) >= F.col("least")).select("run", "least"), "possible")
    found_schema = "host long, page long, run long"
    some = possible.count()  # from the files' footers
    if some:
        sent = np.sort(np.array([r.run for r in possible.select("run").collect()], np.int64)) if some <= MOST_SENT else None
        found = html_of.mapInArrow(listed(sent), found_schema)
        inside = materialize((found if sent is not None else found.join(possible.select("run"), "run", "left_semi")).distinct(), "inside")
        boiler = inside.groupBy("run").agg(F.count(F.lit(1)).alias("n")).join(possible, "run").where("n >= least").select("run")
        held = held.unionByName(inside.join(materialize(boiler, "boilerplate"), "run", "left_semi").select("page", "run", F.lit(True).alias("inside")))
    copied = limits.where("copied").select("host", "least")
    if not copied.isEmpty():  # copies in many parts: no part's counts bound those of distinct pages
        every = materialize(html_of.mapInArrow(listed(None), found_schema).join(copied, "host", "left_semi").distinct(), "inside")
        boiler = every.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).join(copied, "host").where("n >= least").select("run")
        held = held.unionByName(every.join(materialize(boiler, "boilerplate"), "run", "left_semi").select("page", "run", F.lit(True).alias("inside")))
    held = held.groupBy("page").agg(F.collect_list(F.when(~F.col("inside"), F.col("run"))).alias("outside"), F.collect_list(F.when(F.col("inside"), F.col("run"))).alias("inside"))
    held = materialize(held, "held")
    parsed = pages.select("page_id", "url", "html", "host").mapInArrow(parse, f"page_id {kind}, url string, host string, page long, blocks array<struct<text:string,inside:boolean>>")
    wide = parsed.join(held, "page", "left").select("page_id", "url", "host", "blocks", "outside", "inside")
    return wide.mapInArrow(cover, f"page_id {kind}, url string, text string, n_chars long")


def extract(pages: DataFrame, *, depth: int = 8, least_pages: int = 3, article_share: float = 0.5, group_bytes: int = 8_000_000) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    p = pages.select("page_id", "url", "html", host.alias("host"))
    sizes = p.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 1).alias("size"))
    large = materialize(sizes.where(F.col("size") > group_bytes).select("host"), "hosts")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(table: pa.Table) -> pa.Table:
        texts = extract_group(table.column("html").to_pylist(), depth, least_pages, article_share)
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    small = p.join(large, "host", "left_anti").select("host", "page_id", "url", "html").groupBy("host").applyInArrow(run, schema)
    if large.isEmpty():
        return small
    return small.unionByName(extract_large(p.join(large, "host", "left_semi"), depth, least_pages, article_share))
