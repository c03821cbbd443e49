"""The main body of pages, by the importance of their pieces within the site and over all sites.

A piece that n of the m pages of the site hold has the importance 1 - log_m(n): 1 if a single page has it, 0 if all
have. This is the content measure of a site style tree, but no tree is merged: lines are counted by their text, not by
their place, and containers are not counted across pages. Each page's own branches whose content is unimportant, and
side branches that open with an unimportant heading, are removed from it, then the unimportant lines of what is left.
The same measure over all sites together stands in for sites of few pages, where menus and notices can't recur often
enough.

An article that was fetched or printed again with small edits recurs without being boilerplate. Pages that consist
mostly of recurring pieces are therefore counted once for each longest such piece, all others by themselves.

Pages are read once. What is counted are 64-bit keys of pieces; only the keys of unimportant pieces come back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from webloom.llm import spam
from webloom.llm.pages import MAIN_TAGS, Line, Page, parse
from webloom.operators.heavy_keys import host_of
from webloom.session import frozen

#: Pieces on this share of all pages are boilerplate everywhere, however many pages there are; and within a site those below this importance.
ALL_SITES = 0.0008
ONE_SITE = 0.4
#: The fewest pages with a piece, over all sites and within one; the fewest pages of a site that says anything.
FEWEST, FEWEST_ON_SITE, FEWEST_PAGES = 8, 8, 16
#: Where in its page a line of a form that recurs must stand on average to be boilerplate.
FORM_HEAD, FORM_FOOT = 0.12, 0.88
#: Share of a page's words in recurring pieces from which the page may be a near copy and counts by its longest one.
NEAR_COPY = 0.5
#: Containers below this importance are unimportant branches; how fast it passes from presentation to content with the number of children.
UNIMPORTANT, DECAY = 0.3, 0.9
#: Most keys that are sent to the executors; more are joined.
MOST_BROADCAST = 1 << 20

_BARS = re.compile(r"[|·•»›>/]").search
_TRAIL = re.compile(r"\s*[|·•]\s*|\s+[»›>/]\s+")
_COLUMNS = "rep long, host string, lang string, sure boolean, kin string, said array<long>, vocab array<long>, pages array<int>, share double, phrased double, doubted boolean, menus array<long>, lines binary, tree binary, pieces array<long>, weights binary, on_site array<long>, forms array<long>, places array<float>, nodes array<long>, shapes array<long>"
#: Columns of a page's line matrix, then those of spam.measure.
_NO, _AT, _WORDS, _LINKED, _PIECES, _FLAGS, _FORM = range(7)
_HEADLINE, _CRUMB, _DATED, _SHORT = 1, 2, 4, 8


def _key(*parts: str) -> int:
    h = xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _keys(parts: list[str]) -> np.ndarray:
    """``_key`` of each by itself, or of parts that are joined already."""
    try:
        found = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    except UnicodeEncodeError:  # half a surrogate pair
        found = np.array([xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in parts], np.uint64)
    return found.view(np.int64)


def _outside(page: Page) -> list[bool]:
    """Whether each line lies in side matter by the names of its containers."""
    side: list[bool] = []
    for parent, own in zip(page.parents, page.side):
        side.append(own or parent >= 0 and side[parent])
    return [line.container >= 0 and side[line.container] for line in page.lines]


def _flags(line: Line, title: str) -> int:
    if len(line.words) > 60:  # no headline or trail is that long
        return _DATED * line.dated
    text = line.norm
    flags = _HEADLINE if len(text) > 2 and title.startswith(text) and len(text) * 2 > len(title) - 40 else 0
    if not flags and len(line.segments) > 1 and _BARS(text):
        tail = _TRAIL.split(text)[-1].strip()
        flags |= _CRUMB if len(tail) > 2 and title.startswith(tail.rstrip(".… ")) else 0
    return flags | _DATED * line.dated | _SHORT * (len(line.words) <= 6)


_MASK = (1 << 64) - 1


def _paths(page: Page, host: str) -> tuple[list[int], np.ndarray]:
    """Of each container its place in the site's merged tree (host, and styles from the root down), and its style node: the sequence of its children."""
    nodes: list[int] = []
    root = _key("site", host) & _MASK
    for parent, style in zip(page.parents, page.styles):
        above = nodes[parent] if parent >= 0 else root
        x = (above ^ above >> 29) * 0xBF58476D1CE4E5B9 + _style(style) & _MASK
        nodes.append(x ^ x >> 32)
    return nodes, _keys(["\x1f".join(c) for c in page.children])


@lru_cache(1 << 14)
def _style(style: str) -> int:
    return _key("style", style) & _MASK


def _read(batches: Iterator[pd.DataFrame], with_pieces: bool = True) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    vocabulary = spam.Vocabulary()
    spill = lambda last: [(None, None, lang, None, None, [], keys, n, *[None] * (len(names) - 8)) for lang, keys, n in vocabulary.spilled(last)]
    for b in batches:
        rows = []
        for rep, host, text in zip(b["rep"], b["host"], b["page"]):
            host = host or ""
            page = parse(text, host)
            title = page.title.casefold()
            outside = _outside(page)
            found = spam.menu_lines(page, outside)
            lang, sure, words, share, phrased, spamwise = spam.measure(page, outside, *found)
            kin, said = "", []
            if sure:
                vocabulary.add(lang, words)
            else:
                kin, said = spam.kin(words, page.lang), spam.word_keys(line.words for line, count in zip(page.lines, spamwise[:, 3]) if count)
            menus = [_key(host, *line.words) for line, m in zip(page.lines, found[0]) if m]
            n = len(page.lines)
            matrix, pieces, on_site, forms, places = np.zeros((n, 13), np.int32), [], [], [], []
            nodes, shapes = _paths(page, host) if with_pieces else ([], [])
            own = []
            for i, line in enumerate(page.lines if with_pieces else ()):
                pieces += line.segments
                on_site.append("\x1f".join((host, str(nodes[line.container]) if line.container >= 0 else "", *line.segments)))
                form = line.form != ""
                if form:
                    forms.append("form\x1f" + line.form)
                    places.append(i / max(1, n - 1))
                own.append((line.no, line.container, len(line.words), line.link_words, len(line.segments), _flags(line, title), form))
            weights = [s.count(" ") + 1 for s in pieces]
            if own:
                matrix[:, :7] = own
            matrix[:, 7:] = spamwise
            tree = np.array([page.parents, page.side, [s.split(".")[0] in MAIN_TAGS for s in page.styles]], np.int32).T
            rows.append((rep, host, lang, sure, kin, said, None, None, share, phrased, found[1], menus, matrix.tobytes(), tree.tobytes(), _keys(pieces), np.array(weights, np.int32).tobytes(), _keys(on_site), _keys(forms), places, np.array(nodes, np.uint64).view(np.int64), shapes))
        yield pd.DataFrame(rows + spill(False), columns=names)
    yield pd.DataFrame(spill(True), columns=names)


def read_pages(crawl: DataFrame, with_pieces: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct pages, parsed (see ``_COLUMNS``), the words of all languages, and (crawl_id, rep) of the rows that hold the pages.

    Copies of a page are combined before the shuffle and read once, under their smallest crawl_id.
    """
    rows = crawl.select("crawl_id", "url", "page").where(F.col("page").isNotNull() & (F.col("page") != "") & F.col("crawl_id").isNotNull())
    digest = F.unhex(F.md5("page")).alias("digest")
    pages = rows.groupBy(digest).agg(F.min(F.struct("crawl_id", host_of(F.col("url")).alias("host"))).alias("first"), F.first("page").alias("page"))
    parsed = frozen(pages.select(F.col("first.crawl_id").alias("rep"), F.col("first.host").alias("host"), "page").mapInPandas(partial(_read, with_pieces=with_pieces), _COLUMNS), "pages")
    ids = rows.select("crawl_id", digest).distinct()
    reps = ids.groupBy(F.col("digest").alias("d")).agg(F.min("crawl_id").alias("rep"))
    members = ids.join(reps, F.col("digest") == F.col("d")).select("crawl_id", "rep")
    return parsed.where("rep IS NOT NULL"), parsed.where("rep IS NULL").select("lang", "vocab", "pages"), members


def with_site(parsed: DataFrame, vocabulary: DataFrame, *columns: str) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """The pages with rep, lines, menus, the language as all pages tell it, which doubted menus recur on their site, and these columns; and what is calibrated per language."""
    medians = spam.calibrated(parsed.where("sure").select("lang", "share", "phrased"))
    told = frozen(spam.recognized(parsed.where("NOT sure").select("rep", F.array_remove(F.array_distinct("said"), 0).alias("words")), vocabulary), "languages").select("rep", F.col("lang").alias("told"))
    lines = parsed.where("host <> ''").select("rep", F.explode(F.array_distinct("menus")).alias("key"))
    often = lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= spam.MENU_PAGES).select("key")
    doubted = parsed.where("doubted").select("rep", F.explode(F.array_distinct("menus")).alias("key"))
    recurring = frozen(doubted.join(often, "key").groupBy("rep").agg(F.collect_list("key").alias("recurring")), "menus")
    kept = parsed.select("rep", "lang", "sure", "doubted", "menus", "lines", *columns)
    none = F.array().cast("array<long>")
    unsure = kept.where("NOT sure OR doubted").join(told, "rep", "left").join(recurring, "rep", "left")
    unsure = unsure.withColumns({"lang": F.coalesce("told", "lang"), "recurring": F.coalesce("recurring", none)}).drop("told")

    # Pages of no listed language, by what their kin have in common.
    unknown = parsed.where("NOT sure AND kin <> ''").join(told.where("told = 'und'"), "rep").select("rep", "kin", "said", "lines", "phrased")
    function = spam.learned(unknown)
    if function:
        of = unknown.where(F.col("kin").isin(*function))
        again = frozen(of.mapInPandas(spam.relearned(7, function), "rep long, lang string, share double, lines binary"), "relearned")
        medians = {**spam.calibrated(again.select("rep", "lang", "share").join(of.select("rep", "phrased"), "rep")), **medians}
        again = again.select(F.col("rep").alias("r"), F.col("lang").alias("l"), F.col("lines").alias("own"))
        unsure = unsure.join(again, F.col("rep") == F.col("r"), "left").withColumns({"lang": F.coalesce("l", "lang"), "lines": F.coalesce("own", "lines")}).drop("r", "l", "own")
    pages = kept.where("sure AND NOT doubted").withColumn("recurring", none).unionByName(unsure.select("rep", "lang", "sure", "doubted", "menus", "lines", *columns, "recurring"))
    return pages.drop("sure", "doubted"), medians


Marks = tuple[np.ndarray, np.ndarray]


def _marked(parsed: DataFrame, marks: DataFrame) -> tuple[DataFrame, Marks | None]:
    """The pages, and the marks (key, value) in order of key if they are few; else each page has its own of them in the column marks."""
    if marks.count() <= MOST_BROADCAST:
        held = [(r[0], r[1]) for r in marks.select("key", "value").toLocalIterator()]
        keys, values = np.array([k for k, _ in held], np.int64), np.array([v for _, v in held], np.float32)
        return parsed, (keys[order := np.argsort(keys)], values[order])
    every = F.explode(F.array_distinct(F.concat("pieces", "on_site", "forms", "nodes"))).alias("key")
    own = parsed.select("rep", every).join(marks, "key").groupBy(F.col("rep").alias("r")).agg(F.collect_list(F.struct("key", "value")).alias("marks"))
    return parsed.join(own, F.col("rep") == F.col("r"), "left").drop("r"), None


def _own_marks(b: pd.DataFrame, i: int) -> Marks:
    found = b["marks"].iloc[i]
    pairs = sorted((r["key"], r["value"]) for r in found) if found is not None else []
    return np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.float32)


def _looked_up(b: pd.DataFrame, columns: list[str], marks: Marks | None) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """Of each page its keys by column, which of them are marked, and the values of the last column's, nan where there is none. Marks that all pages share are sought for all at once."""
    rows = [[np.asarray(k, np.int64) for k in keys] for keys in zip(*(b[c] for c in columns))]
    if marks is None:
        for i, keys in enumerate(rows):
            there, value = _sought(np.concatenate(keys), _own_marks(b, i))
            *ends, last = accumulate(map(len, keys), initial=0)
            yield keys, [there[a:e] for a, e in pairwise([*ends, last])], value[ends[-1] :]
        return
    there, value = _sought(np.concatenate([k for keys in rows for k in keys] or [np.zeros(0, np.int64)]), marks)
    at = 0
    for keys in rows:
        found = []
        for k in keys:
            begin, at = at, at + len(k)
            found.append(there[begin:at])
        yield keys, found, value[begin:at]


def _sought(keys: np.ndarray, marks: Marks) -> tuple[np.ndarray, np.ndarray]:
    own, values = marks
    if not len(own):
        return np.zeros(len(keys), bool), np.full(len(keys), np.nan, np.float32)
    place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    there = own[place] == keys
    return there, np.where(there, values[place], np.float32(np.nan))


def _classes(marks: Marks | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            looked_up = _looked_up(b, ["pieces", "on_site", "forms"], marks)
            for rep, host, lines, weights, (keys, found, _) in zip(b["rep"], b["host"], b["lines"], b["weights"], looked_up):
                held = np.concatenate([k[f] for k, f in zip(keys, found)]).tolist()
                if not held:
                    rows.append((host, False, int(rep), []))
                    continue
                weights, pieces = np.frombuffer(weights, np.int32), keys[0]
                matrix = np.frombuffer(lines, np.int32).reshape(-1, 13)
                shared = found[0] | np.repeat(found[1], matrix[:, _PIECES])
                near = shared.any() and weights[shared].sum() >= NEAR_COPY * weights.sum()
                # Among the longest the smallest key, so that the order of lines doesn't matter.
                which = min(zip((-weights[shared]).tolist(), pieces[shared].tolist()))[1] if near else rep
                rows.append((host, bool(near), int(which), list(set(held))))
            yield pd.DataFrame(rows, columns=["host", "near", "class", "keys"])

    return run


def unimportant(parsed: DataFrame) -> DataFrame:
    """The keys of pieces, of lines on their site and of forms whose importance is too low.

    Keys on enough pages are counted again, by classes of near copies instead of pages.
    """
    m = max(parsed.count(), 2)
    least = max(FEWEST, ALL_SITES * m)
    counted = F.count("*").alias("n")
    pieces = parsed.select(F.explode(F.array_distinct("pieces")).alias("key")).groupBy("key").agg(counted).where(F.col("n") >= least).select("key", F.lit("").alias("host"))
    sites = parsed.groupBy("host").agg(F.count("*").alias("m")).where(f"host <> '' AND m >= {FEWEST_PAGES}").withColumnRenamed("host", "h")
    lines = parsed.select("host", F.explode(F.array_distinct("on_site")).alias("key")).groupBy("host", "key").agg(counted).where(F.col("n") >= FEWEST_ON_SITE)
    on_site = lines.join(sites, F.col("host") == F.col("h")).select("key", "host")
    forms = parsed.select(F.explode(F.arrays_zip("forms", "places")).alias("f")).groupBy(F.col("f.forms").alias("key")).agg(counted, F.avg("f.places").alias("place"))
    forms = forms.where((F.col("n") >= least) & ((F.col("place") <= FORM_HEAD) | (F.col("place") >= FORM_FOOT))).select("key", F.lit("").alias("host"))
    often = frozen(pieces.union(on_site).union(forms).groupBy("key").agg(F.max("host").alias("host")), "often")

    pages, marks = _marked(parsed.select("rep", "host", "lines", "pieces", "weights", "on_site", "forms", "nodes"), often.select("key", F.lit(0.0).alias("value")))
    classes = frozen(pages.mapInPandas(_classes(marks), "host string, near boolean, class long, keys array<long>"), "classes")
    by_class = F.count_distinct("near", "class")
    again = classes.select("near", "class", F.explode("keys").alias("key")).groupBy("key").agg(by_class.alias("n")).join(often, "key")
    sites = classes.where("host <> ''").groupBy(F.col("host").alias("h")).agg(by_class.alias("m"))
    least_on_site = F.greatest(F.lit(FEWEST_ON_SITE), F.pow(F.col("m").cast("double"), F.lit(1 - ONE_SITE)))
    return again.join(sites, F.col("host") == F.col("h"), "left").where(F.when(F.col("host") == "", F.col("n") >= least).otherwise(F.col("n") > least_on_site - 1e-9)).select("key").distinct()


def presentation(parsed: DataFrame) -> DataFrame:
    """(key, value) of the nodes of all sites' merged trees: their importance by the entropy of their style nodes, 0 if all pages show the same, 1 if no two do.

    A node is a container's path; what it holds on a page, in order, is its style node. Nodes that too few pages have say nothing.
    """
    each = parsed.where("host <> ''").select(F.explode(F.arrays_zip("nodes", "shapes")).alias("e")).groupBy(F.col("e.nodes").alias("key"), F.col("e.shapes").alias("shape")).agg(F.count("*").alias("n"))
    nodes = each.groupBy("key").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s")).where(F.col("m") >= FEWEST_PAGES)
    return nodes.select("key", (1 - F.col("s") / F.col("m") / F.log("m")).cast("float").alias("value"))


def composite(parents: list[int], at: list[int], node: list[float], dull: list[bool]) -> list[float]:
    """Of each container its importance together with what it holds.

    node: the importance of its presentation, nan where the site says nothing. A container of l children has (1 - DECAY^l) of it and
    DECAY^l of the mean of its children, a line being 0 if it is dull and 1 else; one whose presentation is unknown has that mean.
    """
    k = len(parents)
    n, total = [0] * k, [0.0] * k
    for c, d in zip(at, dull):
        if c >= 0:
            n[c] += 1
            total[c] += not d
    out = [0.0] * k
    for c in range(k - 1, -1, -1):
        mean = total[c] / n[c] if n[c] else 0.0
        kept = DECAY ** n[c]
        out[c] = mean if node[c] != node[c] else (1 - kept) * node[c] + kept * mean
        if parents[c] >= 0:
            n[parents[c]] += 1
            total[parents[c]] += out[c]
    return out


def article_lines(lines: np.ndarray, tree: np.ndarray, weights: np.ndarray, dull_pieces: np.ndarray, dull_lines: np.ndarray, dull_forms: np.ndarray, node: np.ndarray) -> list[int]:
    """Numbers of the lines of a page that are left when unimportant branches and lines are removed. node: importance of each container's presentation."""
    n = len(lines)
    if not n:
        return []
    column = lines.T
    words, at, flags = column[_WORDS], column[_AT].tolist(), column[_FLAGS]
    of_line = np.repeat(np.arange(n), column[_PIECES])
    dull_share = np.bincount(of_line, dull_pieces * weights, n) / np.maximum(1, np.bincount(of_line, weights, n))
    linked = column[_LINKED]
    headline = (flags & _HEADLINE) > 0
    dull = (dull_share >= 0.5) | dull_lines | ((flags & _CRUMB) > 0) | ((flags & _DATED) > 0) & (words <= 12) | (linked >= 0.6 * words)
    if dull_forms.any():
        dull[np.flatnonzero(column[_FORM])[dull_forms]] = True
    # A headline recurs as little as its article; what stands in its place is kept if it recurs.
    dull &= ~(headline & (dull_share < 1) & (linked < words))
    if not len(tree):
        return lines[~dull, _NO].tolist()

    # Containers are numbered as they open, so those below one, and the lines in it, stand together.
    parents, k = tree[:, 0].tolist(), len(tree)
    first, last = [n] * k, [0] * k
    for i, c in enumerate(at):
        if c >= 0:
            first[c] = min(first[c], i)
            last[c] = i + 1
    for c in range(k - 1, -1, -1):
        if (p := parents[c]) >= 0:
            first[p], last[p] = min(first[p], first[c]), max(last[p], last[c])
    keep = headline & ~dull
    all_words, lively_words, kept = (list(accumulate(x.tolist(), initial=0)) for x in (words, words * ~dull, keep))
    total = lively_words[-1]
    is_dull, flag, link_words = dull.tolist(), flags.tolist(), linked.tolist()
    importance = composite(parents, at, node.tolist(), is_dull)
    known, side, main = (~np.isnan(node)).tolist(), tree[:, 1].tolist(), tree[:, 2].tolist()
    any_kept = kept[-1] > 0
    removed = np.zeros(n, bool)
    for c in range(k):
        a, b = first[c], last[c]
        if a >= b or main[c] or kept[b] > kept[a]:
            continue
        lively = lively_words[b] - lively_words[a]
        body = lively > 0.5 * total
        heading = is_dull[a] and flag[a] & _SHORT and not flag[a] & (_DATED | _CRUMB) and link_words[a] == 0
        low = importance[c] < UNIMPORTANT if known[c] else side[c]
        if (low or lively < 0.5 * (all_words[b] - all_words[a])) and not body or heading and not (body and not any_kept):
            removed[a:b] = True
    # What lies outside the branch of the headline is no part of its article, if that branch holds most of the page.
    if any_kept:
        left = list(accumulate((words * ~(dull | removed)).tolist(), initial=0))
        c = at[int(np.flatnonzero(keep)[-1])]
        while c >= 0 and left[last[c]] - left[first[c]] <= 0.5 * left[-1]:
            c = parents[c]
        if c >= 0:
            removed[: first[c]] = removed[last[c] :] = True
    return lines[~dull & ~removed, _NO].tolist()


def _judge(medians: dict[str, tuple[float, float]], marks: Marks | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = []
            columns = (b[c] for c in ("lang", "lines", "tree", "menus", "recurring", "weights"))
            looked_up = _looked_up(b, ["pieces", "on_site", "forms", "nodes"], marks)
            for lang, lines, tree, menus, recurring, weights, (_, found, node) in zip(*columns, looked_up):
                matrix = np.frombuffer(lines, np.int32).reshape(-1, 13)
                if spam.verdict(lang, spam.without_menus(matrix[:, 7:], menus, recurring), medians):
                    kept.append([])
                    continue
                kept.append(article_lines(matrix, np.frombuffer(tree, np.int32).reshape(-1, 3), np.frombuffer(weights, np.int32), *found[:3], node))
            yield pd.DataFrame({"rep": b["rep"], "line_nos": kept})

    return run


def main_lines(crawl: DataFrame) -> DataFrame:
    """(crawl_id, line_no) of each line of the page's own article; lines count from 1, split at line feeds.

    Null and empty pages and spam pages have none. Rows that hold equal pages get equal lines; a row that is repeated
    comes out once. Rows without a crawl_id are left out; a null url only means that the page belongs to no site.
    Other columns are not read.
    """
    parsed, vocabulary, members = read_pages(crawl)
    marks = frozen(unimportant(parsed).withColumn("value", F.lit(0.0).cast("float")).unionByName(presentation(parsed)), "marks")
    pages, medians = with_site(parsed, vocabulary, "tree", "pieces", "weights", "on_site", "forms", "nodes")
    pages, marks = _marked(pages, marks)
    judged = pages.mapInPandas(_judge(medians, marks), "rep long, line_nos array<int>")
    return members.join(judged.where(F.size("line_nos") > 0), "rep").select("crawl_id", F.explode("line_nos").alias("line_no"))


def spam_rows(crawl: DataFrame) -> DataFrame:
    """(crawl_id, lang, spam_share) of the rows whose page is keywords, links or tags instead of sentences.

    Null and empty pages are none. Rows with equal pages are judged alike; a repeated row comes out once; rows without
    a crawl_id are left out. Other columns than crawl_id, url and page are not read.
    """
    parsed, vocabulary, members = read_pages(crawl, with_pieces=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for rep, lang, lines, menus, recurring in zip(b["rep"], b["lang"], b["lines"], b["menus"], b["recurring"]):
                matrix = np.frombuffer(lines, np.int32).reshape(-1, 13)[:, 7:]
                matrix = spam.without_menus(matrix, menus, recurring)
                if spam.verdict(lang, matrix, medians):
                    bad, words = spam.spam_share(lang, matrix, medians)
                    got.append((rep, lang, bad / words))
            yield pd.DataFrame(got, columns=["rep", "lang", "spam_share"]).astype({"rep": "int64", "lang": "str", "spam_share": "float64"})

    pages, medians = with_site(parsed, vocabulary)
    judged = pages.mapInPandas(run, "rep long, lang string, spam_share double")
    return members.join(judged, "rep").select("crawl_id", "lang", "spam_share")
