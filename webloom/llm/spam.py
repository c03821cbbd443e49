"""Pages of keywords, links or tags instead of sentences.

Every line outside side matter is judged by itself: does it lack the function words that sentences of the page's
language have, is it all links, is it cut up by separators, does it say again what other lines say, does it circle
around the page's one word, is it made of the page's one phrase? The words of such lines, as a share of all, make the verdict. What share of function
words a sentence must have is calibrated per language, from the distribution over all pages.

A page with hardly any function words may be keywords, or sentences of a language that has no list here. The words of
the pages whose language is sure tell which: if they make up enough of the page's words, it is in their language and
held to it. If not, it belongs with the pages that declare the same language or are written in the same script; the
words that a good part of these have are their function words, from the corpus, and their median is calibrated in the
same way. Where such pages are too few, and for undeclared ones in Latin letters, lines are not asked for function words.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from webloom.llm.pages import Line, Page

_WORD = re.compile(r"[^\W_]+")

#: Function words by language.
FUNCTION_WORDS = {
    "en": "the a an of in to and or is was it its that this which who not than so as at by for from with on into when if after before there their our we you they he she how because has have".split(),
    "de": "der die das den dem des ein eine einen einem und oder ist war sind nicht ohne wenn weil in im am an auf aus bei mit nach noch vom von bis zu zum für so wie es sich sein seine seinen niemand".split(),
    "fr": "le la les l un une des de du et ou est sont ne pas que qui dans sur pour par avec sans son sa ses car quand il elle y à au aux en notre personne après encore".split(),
    "es": "el la los las un una de del y o es son no que en con por para sin su sus porque cuando hay se al lo nuestro nadie desde después ya".split(),
    "it": "il lo la i gli le un una di del della e o è sono non che in con per da su al si come nel più".split(),
    "pt": "o a os as um uma de do da e ou é são não que em com por para sem seu sua no na ao se mais".split(),
    "nl": "de het een van en of is zijn niet dat die in op te met voor aan door bij om er als ook naar".split(),
}
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES_OF = {w: [k for k in _SETS if w in _SETS[k]] for w in frozenset().union(*_SETS.values())}
#: A line must have this part of the median share of function words in its language; lines around a stuffed word, taken together, this part.
OF_MEDIAN, OF_MEDIAN_STUFFED = 0.5, 0.7
#: Share of one word (not a function word) among a page's words that makes it a stuffed word.
STUFFED = 0.09
#: Links, separators and copies above these shares make a line a list.
LINKED, SEPARATED, COPIED = 0.7, 0.22, 0.5
#: Length of the runs of words that are counted, how often and in how many words once it must stand on a page to be a repeat, and the least share of a page's words in repeats that tells.
RUN, REPEATED, ONCE_IN, PHRASED = 4, 4, 200, 0.2
#: The least words in repeats for a page to count as one with repeats at all.
LEAST_PHRASED = 12
#: Lines that look like menus are doubted above this part of the words of the page's other text; then they are menus if so many pages of the site hold them, up to so many words.
OF_TEXT, MENU_PAGES, MENU_WORDS, DOUBTED_WORDS = 0.5, 3, 60, 12
#: A page is spam from this share of words that are stuffed or in such lines, and from so many of these words.
SHARE, LEAST_WORDS = 0.5, 5
#: So many lines that say the page's title, and lines of a date and up to so many words, need no function words.
TITLE_LINES, DATED_WORDS = 2, 12
#: A page's language is sure from this share of its function words; else from this share of distinct words known from pages whose language is.
SURE, KNOWN_WORDS = 0.1, 0.4
#: The fewest pages that make a word known.
FEWEST_PAGES = 2
#: Words on this share of the pages of a language without a list are its function words, if it has so many pages.
LEARNED_SHARE, FEWEST_LEARNED = 0.3, 30


def language(words: Counter, declared: str = "") -> tuple[str, bool]:
    """The language whose function words are the most frequent, und if none makes up 3 percent; whether that is sure.

    A page that declares a language without a list here is never sure.
    """
    total = sum(words.values())
    found = dict.fromkeys(_SETS, 0)
    for w in words.keys() & _LANGUAGES_OF.keys():
        for k in _LANGUAGES_OF[w]:
            found[k] += words[w]
    best = max(found, key=found.get)
    sure = found[best] >= SURE * total and (not declared or declared in _SETS)
    return best if total and found[best] >= 0.03 * total else "und", bool(total) and sure


def word_key(word: str) -> int:
    h = xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@lru_cache(1 << 12)
def _script(letter: str) -> str:
    return unicodedata.name(letter, "").partition(" ")[0].lower()


def kin(words: Counter, declared: str) -> str:
    """With which pages a page of no listed language belongs: those that declare the same one, else those in the same script unless that is Latin, else none."""
    if declared and declared not in _SETS and len(declared) <= 3:
        return declared
    scripts: Counter = Counter()
    for w, n in words.items():
        if not w[0].isdigit():
            scripts[_script(w[0])] += n
    most = max(scripts, key=scripts.get, default="latin")
    return "" if most == "latin" or declared in _SETS else most


def word_keys(lines: Iterable[list[str]]) -> list[int]:
    """Keys of all words in order, 0 for numbers."""
    return [0 if w.isdigit() else word_key(w) for words in lines for w in words]


class Vocabulary:
    """How often words stand in pages of each sure language: a bounded table per task, whose parts add up.

    The words of pages are kept as bytes and counted together when the table is told.
    """

    def __init__(self, most: int = 1 << 21) -> None:
        #: By language the distinct words of each page, and how often each of them stands there.
        self.pages: dict[str, tuple[list[str], array]] = {}
        self.most, self.size = most, 0

    def add(self, lang: str, words: Counter) -> None:
        if not words:
            return
        said, n = self.pages.setdefault(lang, ([], array("i")))
        said.append(" ".join(words))
        n.extend(words.values())
        self.size += len(words)

    def spilled(self, last: bool = False) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """(lang, keys of words, number) and an empty table, if it is full or the last is told."""
        if not last and self.size < self.most:
            return []
        out = []
        for lang, (said, n) in self.pages.items():
            parts = pa.array([x.encode("utf-8", "surrogatepass") for x in said], pa.large_binary())
            words = pc.split_pattern(parts, b" ").flatten().dictionary_encode()
            keys = np.fromiter(map(xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary)).view(np.int64)
            out.append((lang, keys, np.bincount(words.indices.to_numpy(), np.frombuffer(n, np.int32), len(keys)).astype(np.int32)))
        self.pages, self.size = {}, 0
        return out


def is_menu(line: Line) -> bool:
    """A row of single words as links or between bars."""
    n = len(line.words)
    if not 3 <= n <= 20:
        return False
    bars = line.text.count("|") + line.text.count("·")
    return line.links >= 3 and n <= 1.3 * line.links and line.link_words >= LINKED * n or bars >= 2 and n <= 1.3 * (bars + 1)


def menu_lines(page: Page, outside: list[bool]) -> tuple[list[bool], bool]:
    """Which lines outside side matter look like menus, and whether that is in doubt, as they are many against the page's other text."""
    menus = [not o and is_menu(line) for line, o in zip(page.lines, outside)]
    words = sum(len(line.words) for line, m in zip(page.lines, menus) if m)
    rest = sum(len(line.words) for line, m, o in zip(page.lines, menus, outside) if not (m or o))
    return menus, words >= DOUBTED_WORDS and words > OF_TEXT * rest


def without_menus(lines: np.ndarray, keys: np.ndarray, recurring: np.ndarray) -> np.ndarray:
    """Lines as ``measure`` gives them, without words in doubted menus that recur on the site. keys: of the menus in order."""
    at = np.flatnonzero(lines[:, 2] == 2)
    at = at[np.isin(keys, recurring)] if len(at) else at
    if not len(at) or lines[at, 3].sum() > MENU_WORDS:
        return lines
    lines = lines.copy()
    lines[at, 3:] = 0
    return lines


def _phrased(lines: list[list[str]], counts: Counter) -> list[int]:
    """How many words of each line are in runs of RUN words that stand on the page REPEATED times, also across lines.

    On long pages common turns of speech recur too, so a run must make up a part of the page. counts: of the words; a run
    stands on the page no more often than any of its words.
    """
    words = list(chain.from_iterable(lines))
    least = max(REPEATED, len(words) / ONCE_IN)
    often = {w for w, n in counts.items() if n >= least}
    # A byte per word; runs are put together only where all their words are frequent.
    frequent, full = bytes(map(often.__contains__, words)), bytes(RUN * [1])
    starts, i = [], frequent.find(full)
    while i >= 0:
        starts.append(i)
        i = frequent.find(full, i + 1)
    if len(starts) < REPEATED:
        return [0] * len(lines)
    runs = [tuple(words[i : i + RUN]) for i in starts]
    counts = Counter(runs)
    covered = bytearray(len(words))
    for i, run in zip(starts, runs):
        if counts[run] >= least:
            covered[i : i + RUN] = full
    if covered.count(1) < LEAST_PHRASED:
        return [0] * len(lines)
    ends = list(accumulate(map(len, lines), initial=0))
    return [covered.count(1, a, e) for a, e in pairwise(ends)]


def measure(page: Page, outside: list[bool], menus: list[bool] | None = None, doubted: bool = False) -> tuple[str, bool, Counter, float, float, np.ndarray]:
    """Language, whether it is sure, words with their number, its share of function words, the share of words in repeats, and per line: function words per 1000 words, whether these are pooled, list-like for other reasons, words, stuffed words, words in repeated runs.

    outside: lines that are side matter by their place; they and menus count no words. menus, doubted: as
    ``menu_lines`` gives them; doubted menus count as lists, marked by 2. The words of lines around a
    stuffed word are pooled, without that word, as single lines are too short to tell a sentence.
    """
    if menus is None:
        menus, doubted = menu_lines(page, outside)
    inner = [not (o or m and not doubted) for o, m in zip(outside, menus)]
    within = [line.words for line, ok in zip(page.lines, inner) if ok]
    counts = Counter(chain.from_iterable(within))
    total = sum(counts.values())
    lang, sure = language(counts, page.lang)
    function = _SETS.get(lang, frozenset())
    top = {w for w, n in counts.items() if n >= 4 and n > STUFFED * total and w not in function}
    seen = Counter(chain.from_iterable(line.segments for line, ok in zip(page.lines, inner) if ok))
    again = {s for s, n in seen.items() if n > 2}
    phrased = _phrased(within, counts)
    said = iter(phrased)
    title = frozenset(_WORD.findall(page.title.casefold()))
    rows, left = [], TITLE_LINES
    around, pool, pooled = [], 0, 0
    is_top, is_again, in_title = top.__contains__, again.__contains__, title.__contains__
    # A byte per word of the page, which are counted by line.
    is_function, at = bytes(map(function.__contains__, chain.from_iterable([line.words for line in page.lines]))), 0
    for i, (line, ok) in enumerate(zip(page.lines, inner)):
        words = line.words
        n = len(words)
        has = is_function.count(1, at, at + n)
        at += n
        tops = sum(map(is_top, words)) if top else 0
        listed = line.link_words >= LINKED * n or line.separators >= 4 and line.separators >= SEPARATED * n
        listed = listed or bool(again) and sum(map(is_again, line.segments)) > COPIED * len(line.segments)
        rows.append([1000 * has // max(1, n - tops), tops > 0, 2 if menus[i] and doubted else listed, n if ok else 0, tops if ok else 0, next(said) if ok else 0])
        if tops and ok:
            around.append(i)
            pool += n - tops
            pooled += has
    for i in around:
        rows[i][0] = 1000 * pooled // max(1, pool)
    for i, line in enumerate(page.lines):
        says = left > 0 and len(line.words) <= 2 * len(title) and 2 * sum(map(in_title, line.words)) >= len(line.words)
        left -= says
        if says or line.dated and len(line.words) <= DATED_WORDS:
            rows[i][0] = 1000
    rows = np.array(rows, np.int32).reshape(-1, 6)
    share = sum(counts[w] for w in counts.keys() & function) / total if total else 0.0
    return lang, sure, counts, share, sum(phrased) / max(1, total), rows


def calibrated(measured: DataFrame) -> dict[str, tuple[float, float]]:
    """Per language, over all its pages, the median share of function words, and from what share on words in repeats tell.

    measured: (lang, share, phrased). The latter is twice the median
    share of repeats, PHRASED at least and SHARE at most.
    """
    median = lambda c: F.percentile_approx(c, 0.5, 1000).alias(c)
    rows = measured.groupBy("lang").agg(median("share"), median("phrased")).collect()
    return {r["lang"]: (r["share"], min(SHARE, max(PHRASED, 2 * r["phrased"]))) for r in rows}


def recognized(unsure: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(rep, lang) of the pages whose language isn't sure: the one that knows the most of their words, und if it knows too few.

    unsure: (rep, words), distinct; vocabulary: (lang, vocab, pages) as tasks spilled it. A word belongs to the language in which most pages have it.
    """
    parts = vocabulary.select("lang", F.explode(F.arrays_zip("vocab", "pages")).alias("v")).select("lang", F.col("v.vocab").alias("word"), F.col("v.pages").alias("n"))
    counted = parts.groupBy("word", "lang").agg(F.sum("n").alias("n"))
    known = counted.groupBy("word").agg(F.max_by("lang", F.struct("n", "lang")).alias("of"), F.max("n").alias("n")).where(F.col("n") >= FEWEST_PAGES).select("word", "of")
    own = unsure.select("rep", F.explode("words").alias("word")).join(known, "word").groupBy("rep", "of").agg(F.count("*").alias("n"))
    best = own.groupBy(F.col("rep").alias("r")).agg(F.max_by("of", F.struct("n", "of")).alias("of"), F.sum("n").alias("n"))
    enough = F.col("n") >= KNOWN_WORDS * F.size("words")
    return unsure.join(best, F.col("rep") == F.col("r"), "left").select("rep", F.when(enough, F.col("of")).otherwise("und").alias("lang"))


def with_learned(lines: np.ndarray, said: np.ndarray, function: np.ndarray) -> tuple[np.ndarray, float]:
    """Lines as ``measure`` gives them, with the shares of the function words with these keys, and their share in all. said: keys of the words of the lines that count, in order."""
    lines = lines.copy()
    n, tops = lines[:, 3], lines[:, 4]
    ends = np.cumsum(n)
    before = np.concatenate([[0], np.cumsum(np.isin(said, function))])
    has = before[ends] - before[ends - n]
    around = (lines[:, 1] > 0) & (n > 0)
    lines[:, 0] = 1000 * has // np.maximum(1, n - tops)
    if around.any():
        lines[around, 0] = 1000 * has[around].sum() // max(1, int((n - tops)[around].sum()))
    return lines, float(has.sum() / max(1, ends[-1])) if len(ends) else 0.0


def learned(unknown: DataFrame) -> dict[str, np.ndarray]:
    """Keys of the function words of each language or script that enough of the pages ``unknown`` (kin, said) share; few per language, as each is on a good part of its pages."""
    pages = unknown.where("kin <> ''").groupBy("kin").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= FEWEST_LEARNED)
    words = unknown.select("kin", F.explode(F.array_distinct("said")).alias("word")).where("word <> 0").groupBy("kin", "word").agg(F.count("*").alias("n"))
    rows = words.join(F.broadcast(pages.withColumnRenamed("kin", "k")), F.col("kin") == F.col("k")).where(F.col("n") >= LEARNED_SHARE * F.col("n_pages")).select("kin", "word").collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["kin"], []).append(r["word"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def relearned(columns: int, function: dict[str, np.ndarray]):
    """Rows (rep, kin, said, lines) as (rep, lang, share, lines): by learned function words. columns: of a line before those of ``measure``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rep, kin_, said, lines in zip(b["rep"], b["kin"], b["said"], b["lines"]):
                matrix = np.frombuffer(lines, np.int32).reshape(-1, columns + 6)
                own, share = with_learned(matrix[:, columns:], np.asarray(said, np.int64), function[kin_])
                out.append((rep, kin_, share, np.hstack([matrix[:, :columns], own]).astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["rep", "lang", "share", "lines"])

    return run


def spam_share(lang: str, lines: np.ndarray, medians: dict[str, tuple[float, float]]) -> tuple[int, int]:
    """Words that are stuffed or in lines that aren't sentences, and all words, of lines as ``measure`` gives them.

    Lines of a language that has no median, like und, are not asked for function words.
    """
    if not len(lines):
        return 0, 0
    # Lists, as a page has few lines.
    has, around, listed, words, tops, phrased = lines.T.tolist()
    least, most = medians.get(lang, (0.0, PHRASED))
    total = sum(words)
    own = map(max, tops, phrased) if sum(phrased) >= most * total else tops
    alone, pooled = 1000 * least * OF_MEDIAN, 1000 * least * OF_MEDIAN_STUFFED
    bad = sum(n if is_list > 0 or f < (pooled if a > 0 else alone) else o for f, a, is_list, n, o in zip(has, around, listed, words, own))
    return bad, total


def verdict(lang: str, lines: np.ndarray, medians: dict[str, tuple[float, float]]) -> bool:
    bad, words = spam_share(lang, lines, medians)
    return bad >= LEAST_WORDS and bad >= SHARE * words
