"""HTML extraction: a suffix array over the pages of each host, then a check by page structure.

Every page is read into blocks of text, menus and footers included, with their place: in
a marked article, outside of it (menus, headers, footers, sidebars, notices, adverts,
forms, comments of readers, and all else on a page that marks an article), or open, where
the markup does not tell. Scripts, styles and markup are no text.

All tokens of all pages go through suffix arrays. Pages are taken in shards of bounded
size; each shard's token streams are sorted by prefix doubling, hosts apart, which gives
for every run of ``RUN`` tokens the distinct pages that hold it inside and outside of
marked articles. Those counts, not texts, are shuffled and added up for each host. Runs on
``PAGES`` pages or more are boilerplate, unless more of them hold it inside of an article.

Then each page's tokens are looked up among its host's boilerplate runs, and covered
tokens are removed. The check by structure follows, as copies of an article on one host,
and licence lines of many articles, repeat just like boilerplate, while menus and adverts
may differ on every page: what was removed from a marked article is restored, and what is
left outside of it, or in an element that is never article, goes too. ``n_repeated`` and
``n_restored`` tell how many tokens of a page repetition removed and the check gave back.

Defined results: null or empty html gives empty text; a page without any element
is one block; ties and repeated rows are separate pages of their host, so that a
row's copies count as pages; a null url is a host of its own; extra columns are
ignored; an empty table gives no rows. Runs are named by 52 bits of a hash.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, fresh_dir, stored
from .hashing import buffers, mixed, span_hashes, spans

#: Tokens in a run, and distinct pages of a host that make a run boilerplate.
RUN, PAGES = 6, 4
#: Tokens that one task sorts at once.
SHARD_TOKENS = 2_000_000
#: Bits of a run's name; names of runs that a task reads at once.
NAME_BITS, NAMES_READ = 52, 1_000_000

# Element names and words in class or id attributes, by their meaning in HTML.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title", "xmp", "noembed", "noframes")
NEVER = ("nav", "header", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "canvas", "audio", "video", "map", "label", "fieldset", "legend", "datalist", "search")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
MARKED = "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus foot footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets"
ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar"
MAIN = ("article", "main")
MAIN_MARKED = "article articlebody article-body article-content content content-body entry-content main main-content maincontent post post-body post-content story story-body"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
_marked, _roles, _main = frozenset(MARKED.split()), frozenset(ROLES.split()), frozenset(MAIN_MARKED.split())
_raw, _never, _inline, _void = frozenset(RAW), frozenset(NEVER), frozenset(INLINE), frozenset(VOID)
ARTICLE, OPEN, OUTSIDE = 0, 1, 2


def judged(name: str, attributes: str, inside: bool) -> str:
    """'never', 'main', 'part' (of the article's own header) or '' for an element; inside: of an article."""
    if name in _never:
        return "" if name == "header" and inside else "never"
    if attributes and "=" in attributes or "hidden" in attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return "never"
            if key == "role" and value in _roles:
                return "never"
            if key in ("class", "id"):
                words = set(value.split())
                if words & _main or key == "class" and name in MAIN:
                    return "main"
                if words & _marked or any(part in _marked for w in words for part in re.split(r"[-_]+", w)):
                    return "never"
            if key == "itemprop" and value == "articlebody" or key == "role" and value in MAIN:
                return "main"
    return "main" if name in MAIN else ""


def regions(page: str | None) -> list[tuple[int, str]]:
    """(ARTICLE, OPEN or OUTSIDE, text) of all blocks of a page, in order.

    Blocks inside any marked article or main element are ARTICLE, and if there are any, all
    others are OUTSIDE; else blocks outside of never-article elements are OPEN. An end tag
    costs the elements that it closes, however many are open.
    """
    page = page if isinstance(page, str) else ""
    found: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str]] = []  # open block-level or judged elements
    places: dict[str, list[int]] = {}  # of open elements by name, and of judged ones
    judged_at: list[int] = []
    never = main = 0
    at = 0

    def flush() -> None:
        if text:
            block = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if block:
                found.append((OUTSIDE if never else ARTICLE if main else OPEN, block))

    def pop() -> None:
        nonlocal never, main
        name, kind = stack.pop()
        places[name].pop()
        if kind:
            judged_at.pop()
            never -= kind == "never"
            main -= kind == "main"

    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        close, name, attributes, end = m.groups()
        if name is None:
            continue
        name = name.lower()
        if not close and name in _raw:
            if not attributes.rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = over.end() if over else len(page)
            continue
        if name in ("br", "wbr", "img"):
            text.append(" " if name == "br" else "")
            continue
        kind = "" if close else judged(name, attributes, main > 0)
        if name in _inline and not kind and not (close and places.get(name)):
            continue
        if name in _inline and not kind:  # closes a judged inline element, if no block was opened since
            if stack[-1][0] != name:
                continue
        flush()
        if name in _void or not close and attributes.rstrip().endswith("/") and end:
            continue
        if not close:
            if name == "p" or name == "li":  # these end the one before
                while stack and stack[-1][0] == name and not stack[-1][1]:
                    pop()
            places.setdefault(name, []).append(len(stack))
            if kind:
                judged_at.append(len(stack))
                never += kind == "never"
                main += kind == "main"
            stack.append((name, kind))
        elif places.get(name):
            # an end tag closes what it opened, but does not reach out of a judged element for an unjudged one
            k = places[name][-1]
            if stack[k][1] or not judged_at or judged_at[-1] <= k:
                while len(stack) > k:
                    pop()
    if at < len(page):
        text.append(re.sub(r"<[/!?a-zA-Z][^>]*\Z", "", page[at:]))
    flush()
    if any(kind == ARTICLE for kind, _ in found):
        return [(kind if kind == ARTICLE else OUTSIDE, b) for kind, b in found]
    return found


def blocks(page: str | None) -> list[tuple[int, str]]:
    """The regions of a page that may be article: marked ones, or else the open ones."""
    return [(kind, b) for kind, b in regions(page) if kind != OUTSIDE]


def suffix_runs(stream: np.ndarray, pages: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the suffixes of a stream of numbers by their first ``run`` tokens, by prefix doubling.

    Returns (places in sorted order, first of each class of equal runs, distinct
    pages of each class). Runs that reach into another page are left out.
    """
    n = len(stream)
    starts = np.flatnonzero(pages[: n - run + 1] == pages[run - 1 :]) if n >= run else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts, starts
    rank, length = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
    while length < run:
        step = min(length, run - length)
        after = np.concatenate([rank[step:], np.full(step, -1)])
        rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    order = np.sort(rank[starts] * n + starts) % n  # pages ascend with places
    r, p = rank[order], pages[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    new_page = (np.diff(r, prepend=-1) != 0) | (np.diff(p, prepend=-1) != 0)
    return order, first, np.add.reduceat(new_page.astype(np.int64), first)


def run_keys(stream: np.ndarray, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for k in range(run):
        h = (h ^ stream[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def placed(batches: Iterator[pd.DataFrame], shard_tokens: int) -> Iterator[list[tuple]]:
    """Shards of about that many tokens: lists of (page_id, url, host, regions), whole pages."""
    shard, n = [], 0
    for batch in batches:
        for page_id, url, host, html in zip(batch.page_id, batch.url, batch.host, batch.html, strict=True):
            found = regions(html)
            shard.append((page_id, url, host, found))
            n += sum(b.count(" ") + 1 for _, b in found)
            if n >= shard_tokens:
                yield shard
                shard, n = [], 0
    if shard:
        yield shard


def stream_of(shard: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a shard as numbers, hosts apart, and of each token its block; of each block its page and whether it is ARTICLE.

    Blocks are numbered page by page, those of its article after the others.
    """
    texts, page, inside, hosts = [], [], [], []
    for k, (_, _, host, found) in enumerate(shard):
        hosts.append((host or "").encode("utf-8", "surrogatepass"))
        for article in (False, True):
            for kind, b in found:
                if (kind == ARTICLE) == article:
                    texts.append(b.encode("utf-8", "surrogatepass"))
                    page.append(k)
                    inside.append(article)
    numbers, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, data, places in buffers(texts):
        raw = np.frombuffer(data, np.uint8)
        starts, ends = spans((raw != 32) & (raw != 10))
        numbers.append(span_hashes(raw, starts, ends))
        counts.append(np.diff(np.searchsorted(starts, places)))
    page, block = np.array(page, np.int64), np.repeat(np.arange(len(texts)), np.concatenate(counts))
    own = np.concatenate([span_hashes(np.frombuffer(h, np.uint8), np.array([0]), np.array([len(h)])) for h in hosts])
    return mixed(np.concatenate(numbers) + own[page[block]]), block, page, np.array(inside, bool)


def run_names(stream: np.ndarray, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    return run_keys(stream, starts, run).view(np.uint64) >> np.uint64(64 - NAME_BITS)


def packed(values: np.ndarray) -> bytes:
    """Numbers, those of like bytes together, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return planes.reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


def parsed(pages: DataFrame, empty: bool = True) -> DataFrame:
    """page_id, url, html, host of every page, or of those that are not empty."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    return read if empty else read.where("html != ''")


def dealt(pages: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """pages with the tokens of a shard; a task deals its pages to shards as it reads them, so no text is shuffled."""
    return pages.withColumn("shard_tokens", F.lit(shard_tokens))


def boilerplate(shards: DataFrame, run: int = RUN, least_pages: int = PAGES) -> DataFrame:
    """(host, key): the names of each host's boilerplate runs. shards: as ``dealt`` gives."""
    wide = max(shards.rdd.getNumPartitions(), int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = min(max(wide - 1, 1).bit_length(), 32)  # runs are dealt by so many bits of their names, as many as a task of the input has

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first_batch = next(batches, None)
        if first_batch is None or not len(first_batch):
            return
        for shard in placed(itertools.chain([first_batch], batches), int(first_batch.shard_tokens.iloc[0])):
            stream, block, page, inside = stream_of(shard)
            segment = 2 * page[block] + inside[block]
            order, first, _ = suffix_runs(stream, segment, run)
            if not len(first):
                continue
            names, held = run_names(stream, order[first], run), segment[order]
            new = np.diff(held, prepend=-1) != 0
            new[first] = True
            within = np.add.reduceat((new & (held & 1 == 1)).astype(np.int64), first).astype(np.uint32)
            outside = np.add.reduceat((new & (held & 1 == 0)).astype(np.int64), first).astype(np.uint32)
            hosts, of_page = np.unique(np.array([h or "" for _, _, h, _ in shard], object), return_inverse=True)
            host = of_page[held[first] >> 1].astype(np.uint32)
            by = np.argsort(names)
            names, host, within, outside = names[by], host[by], within[by], outside[by]
            bucket = names >> np.uint64(NAME_BITS - bits)
            cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] + np.uint64(1)))
            yield pd.DataFrame([(int(bucket[a]), hosts.tolist(), packed(np.diff(names[a:b], prepend=np.uint64(0))), *(packed(x[a:b]) for x in (host, within, outside))) for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True)], columns=["bucket", "hosts", "names", "host", "within", "outside"])

    def add(bucket: pd.DataFrame) -> pd.DataFrame:
        names = np.concatenate([np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in bucket.names])
        within, outside = (np.concatenate([unpacked(x, np.uint32) for x in bucket[c]]).astype(np.int64) for c in ("within", "outside"))
        order = np.argsort(names)
        first = np.flatnonzero(np.diff(names[order], prepend=names[order[0]] + np.uint64(1)))
        within, outside = np.add.reduceat(within[order], first), np.add.reduceat(outside[order], first)
        bad = order[first[(within + outside >= least_pages) & (outside >= within)]]
        hosts = [unpacked(x, np.uint32) for x in bucket.host]
        row, number = np.searchsorted(np.cumsum([len(x) for x in hosts]), bad, "right"), np.concatenate(hosts)[bad]
        return pd.DataFrame({"host": pd.Series([bucket.hosts.iloc[r][n] for r, n in zip(row, number, strict=True)], dtype=object), "key": names[bad].astype(np.int64)})

    counts = shards.select("page_id", "url", "html", "host", "shard_tokens").mapInPandas(count, "bucket long, hosts array<string>, names binary, host binary, within binary, outside binary")
    return counts.groupBy("bucket").applyInPandas(add, "host string, key long")


def written(bad: DataFrame) -> str:
    """Writes the names of boilerplate runs to files in the shared folder, ascending in each; returns the folder."""
    folder = fresh_dir(bad.sparkSession, "runs")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        names = np.sort(np.concatenate([np.zeros(0, np.int64), *(batch.key.to_numpy(np.int64) for batch in batches)]))
        if len(names):
            (fs, base), task = file_system(folder), TaskContext.get()
            fs.create_dir(base, recursive=True)
            temporary = f"{base}/.{task.partitionId():06d}.{task.taskAttemptId()}"
            with fs.open_output_stream(temporary) as sink:
                sink.write(names.astype("<i8").tobytes())
            fs.move(temporary, f"{base}/{task.partitionId():06d}.names")
            yield pd.DataFrame({"names": [len(names)]})

    bad.select("key").mapInPandas(write, "names long").agg(F.sum("names")).first()
    return folder


def names_in(folder: str) -> Iterator[np.ndarray]:
    """The names in a folder that ``written`` made, ascending in each part of about ``NAMES_READ``."""
    from pyarrow.fs import FileSelector

    fs, base = file_system(folder)
    part, n = [], 0
    for path in sorted(f.path for f in fs.get_file_info(FileSelector(base, allow_not_found=True)) if f.path.endswith(".names")):
        with fs.open_input_file(path) as file:
            part.append(np.frombuffer(file.read(), "<i8"))
        n += len(part[-1])
        if n >= NAMES_READ:
            yield np.sort(np.concatenate(part)).view(np.uint64)
            part, n = [], 0
    if part:
        yield np.sort(np.concatenate(part)).view(np.uint64)


def covered(stream: np.ndarray, block: np.ndarray, folder: str, run: int = RUN) -> np.ndarray:
    """Of each token whether a run inside of its block that is named in the folder covers it."""
    n = len(stream)
    starts = np.flatnonzero(block[: n - run + 1] == block[run - 1 :]) if n >= run else np.zeros(0, np.int64)
    names, hit = run_names(stream, starts, run), np.zeros(len(starts), bool)
    for bad in names_in(folder):
        hit |= bad[np.minimum(np.searchsorted(bad, names), len(bad) - 1)] == names
    cover = np.zeros(n + 1, np.int64)
    cover[starts[hit]] += 1
    cover[starts[hit] + run] -= 1
    return np.cumsum(cover)[:-1] > 0


def checked(found: list[tuple[int, str]], gone: list[np.ndarray]) -> str:
    """The text of a page after the check by structure; gone: of each block's tokens whether repetition removed them."""
    left = []
    for (kind, b), g in zip(found, gone, strict=True):
        if kind == OPEN and g.any():
            b = " ".join(t for t, out in zip(b.split(" "), g, strict=True) if not out)
        if kind != OUTSIDE and b:
            left.append(b)
    return "\n\n".join(left)


def main_text(pages: DataFrame, run: int = RUN, least_pages: int = PAGES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated, n_restored) for every row of pages; blocks are joined by two newlines."""
    # pages are read twice rather than stored in between: their texts are as large as the input
    folder = written(stored(boilerplate(dealt(parsed(pages, False), shard_tokens), run, least_pages)))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in placed(batches, shard_tokens):
            stream, block, page, inside = stream_of(shard)
            gone = covered(stream, block, folder, run)
            ends = np.searchsorted(block, np.arange(len(page) + 1))
            first = np.searchsorted(page, np.arange(len(shard) + 1))
            repeated = np.bincount(page[block], gone, len(shard)).astype(np.int64)
            restored = np.bincount(page[block], gone & inside[block], len(shard)).astype(np.int64)
            texts = []
            for k, (_, _, _, found) in enumerate(shard):
                if repeated[k] == restored[k]:  # the check gives all back
                    texts.append("\n\n".join(b for kind, b in found if kind != OUTSIDE))
                    continue
                own = sorted(found, key=lambda f: f[0] == ARTICLE)  # as the stream has them; a page has ARTICLE or OPEN blocks, not both
                texts.append(checked(own, [gone[ends[b] : ends[b + 1]] for b in range(first[k], first[k + 1])]))
            yield pd.DataFrame({"page_id": pd.Series([p for p, _, _, _ in shard], dtype="Int64"), "url": pd.Series([u for _, u, _, _ in shard], dtype=object), "text": texts, "n_repeated": repeated, "n_restored": restored})

    read = parsed(pages).mapInPandas(clean, "page_id long, url string, text string, n_repeated long, n_restored long")
    return read.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated", "n_restored")
