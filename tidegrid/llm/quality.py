"""Per-document text statistics, and with them prose apart from lists, tables and junk.

A text is read in stretches of neighbouring lines, long enough that a line break inside a sentence plays no part. Each
stretch is prose or not by the combined shares of letters, symbols, figures and common words, by the order of its words
and by its place in a list; headings and page headers count on neither side. Repetition statistics (duplicate lines and
paragraphs, coverage by the dominant n-grams, runs met before) separate boilerplate. A document whose counted characters
are prose to half at most, or that mostly repeats itself, isn't natural prose.

Texts of a batch are read together: characters by a table of classes, words by their number in one vocabulary, and
stretches by sums between their bounds, so that Python's own loop goes over lines, not over stretches and words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import count, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.words import plain

ALPHA = re.compile(r"[^\W\d_]+")
YEAR = re.compile(r"\d/\d|\d{4}")
BASE = np.uint64(1_000_003)
MASK = re.compile("[█▓■▉_*]{3,}|\\[[^\\]\n]{0,12}\\]")
PAGE = re.compile(r"\b(?:page|seite|página|pagina|p\.|s\.)\s*\d+|^\s*-?\s*\d+\s*-?\s*$|^\s*[^\W\d_]{2,6}\s+\d{1,6}/\d{2,4}\s*\d*\s*$")
#: One of these stands in every match of PAGE that doesn't end with a figure or a dash.
PAGE_SIGNS = ("page", "seite", "pagina", "página", "p.", "s.")
#: The first line of a list's entry or of a numbered paragraph.
ENTRY = re.compile(r"(?:[-*•–·]|[(\[]?([a-z]|\d{1,4})[.)\]]|§\s?(\d{1,4}))\s")
#: How sentences end.
STOP = re.compile("[.!?…][\"'”»)\\]]*(?:\\s|$)")
#: What stands between the entries of a list on one line; a closing quotation mark only where none is opened.
MARKS = (" | ", " / ", " · ", " • ", " › ", " > ", " » ")
BETWEEN = re.compile(r" [|/·•›>] |(?<=\S) » ")
ENDS = tuple(".!?;:…”»\"')")
STRETCH = 160
#: Characters of texts that are read together.
TOGETHER = 1 << 20
#: Share of a text's characters up to which lines in the form of page headers are set aside.
HEADERS = 0.2
#: Shares from which a text repeats itself: duplicate lines, duplicate paragraphs, and the dominant n-gram's coverage
#: together with words in runs met before.
COPIES, PARAGRAPHS, GRAM, AGAIN = 0.4, 0.5, 0.25, 2 / 3
#: Pairs of neighbouring words that no sentence has, by language: an article, and what doesn't follow it.
CLASHES = (
    ("the a", "of to and in is was that the a an it by for on with at be been had has have which were or as from are"),
    ("des einem einen eines", "und oder ist war hat dass wird sind nicht"),
    ("le les du des au aux cette", "et est que qui de du des le la les un une dans par pour sur ne se pas"),
    ("el los las del al", "y es en por con el la los las un una del al fue ha"),
)
#: Clashing pairs, and their share of the articles, from which the words around a stretch stand in no order.
CLASH_COUNT, CLASH_SHARE, CLASH_REACH = 2, 0.15, 2
SCHEMA = (
    "doc_id bigint, n_words bigint, mean_word_length double, symbol_ratio double, digit_ratio double, line_end_punctuation_share double, common_word_share double, "
    "duplicate_line_share double, duplicate_paragraph_share double, top_gram_coverage double, repeated_run_share double, prose_share double, is_prose boolean"
)


@cache
def _classes() -> np.ndarray:
    """Class of every character: 1 letter, 2 digit, 3 blank, 0 else."""
    every = "".join(map(chr, range(0x110000)))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((1, ALPHA), (2, re.compile("[0-9]+")), (3, re.compile("[ \t]+"))):
        for m in pattern.finditer(every):
            table[m.start() : m.end()] = kind
    return table


def listed_lines(lines: Sequence[str], whole: str) -> set[int]:
    """Numbers of the lines (stripped, in order, empty ones among them) of the text `whole` that are parts of a list.

    Entries begin like ENTRY, their numbers or letters one after another, and go on to the next entry or empty line. Three
    or more in a row are a list if in fewer than half of them a sentence ends; paragraphs of prose have some. A line with three or more short parts between
    BETWEEN marks is a list by itself."""
    found: set[int] = set()
    run: list[list[int]] = []
    begins: dict[int, int] = {}  # where the text of an entry begins in its first line
    last = ""  # the number or letter of the run's last entry

    def close() -> None:
        if len(run) >= 3 and sum(any(STOP.search(lines[i], begins.get(i, 0)) for i in e) for e in run) < len(run) / 2:
            found.update(i for e in run for i in e)
        run.clear()

    inside, marked = False, any(x in whole for x in MARKS)
    for i, t in enumerate(lines):
        m = ENTRY.match(t) if t else None
        if m:
            number = m[1] or m[2] or ""
            if number in ("1", "a") or not run:
                close()
            elif number and not _follows(last, number):  # a citation, an initial: no entry
                m = None
        if m:
            run.append([i])
            begins[i] = m.end()
            inside, last = True, number or last
        elif not t:
            inside = False
        elif inside:
            run[-1].append(i)
        elif run:
            close()
        if marked and t and any(x in t for x in MARKS) and not (" » " in t and "«" in t):
            parts = BETWEEN.split(t)
            if len(parts) >= 3 and len(t) < 45 * len(parts):
                found.add(i)
    close()
    return found


def _follows(last: str, number: str) -> bool:
    """Whether a number or letter comes next after another."""
    if last.isdecimal():
        return number.isdecimal() and int(number) == int(last) + 1
    return not last or len(number) == 1 and ord(number) == ord(last) + 1


class _Text:
    """A text cut into stretches: `line` is what is read of it, `bounds` where stretches begin in it, `kinds` what they
    are (0 read by their words, 1 list, 2 set aside)."""

    __slots__ = ("bounds", "ends", "kinds", "line", "copies", "paragraphs", "total")

    def __init__(self, text: str | None) -> None:
        self.line, self.bounds, self.kinds = "", [], []
        if not text:
            return
        folded = plain(text)
        lines = list(map(str.strip, folded.split("\n")))
        lowered = [t for t in lines if t]
        if not lowered:
            return
        once = set(lowered)
        self.total = sum(map(len, lowered))
        self.copies = (self.total - sum(map(len, once))) / self.total
        self.ends = sum(map(str.endswith, lowered, repeat(ENDS))) / len(lowered)
        paragraphs = [t for t in folded.split("\n\n") if t]
        self.paragraphs = 1 - len(set(paragraphs)) / len(paragraphs)
        # heading: the short lines before the first blank line; page headers: by their form, unless they come in masses
        head = [t.strip() for t in folded.lstrip().split("\n\n", 1)[0].split("\n")]
        aside = set(head) if 2 <= len(head) <= 6 and _court(head) else set()
        pages = {t for t in once if len(t) < 90 and (t[-1].isdecimal() or t[-1] == "-" or any(x in t for x in PAGE_SIGNS)) and PAGE.search(t)}
        if pages:
            count = Counter(lowered) if self.copies else dict.fromkeys(pages, 1)
            if sum(len(t) * count[t] for t in pages) <= HEADERS * self.total:
                aside |= pages
        kept = [t for t in lines if t not in aside] if aside else lines
        listed = listed_lines(kept, folded)
        parts: list[str] = []
        at = size = 0
        kind = -1
        for number, t in enumerate(kept):
            if not t:
                continue
            here = 1 if number in listed else 0
            for k in range(0, len(t), STRETCH):
                n = min(STRETCH, len(t) - k)
                if kind != here or size + n > STRETCH:
                    self.bounds.append(at)
                    self.kinds.append(here)
                    kind, size = here, 0
                size += n
                at += n
            parts.append(t)
            at += 1
        if aside:
            self.bounds.append(at)
            self.kinds.append(2)
            parts += [t for t in lowered if t in aside]
        self.line = " ".join(parts)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[edges[i]:edges[i+1]]."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[edges[1:]] - total[edges[:-1]]


def _distinct(group: np.ndarray, ids: np.ndarray, groups: int) -> np.ndarray:
    """Number of different ids in each group."""
    pair = np.sort(group.astype(np.int64) << 32 | ids)
    new = np.ones(len(pair), bool)
    np.not_equal(pair[1:], pair[:-1], out=new[1:])
    return np.bincount(pair[new] >> 32, minlength=groups)


def grams(ids: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of n words that lie in one document begin, and their hashes (modulo 2^64, with the document's number)."""
    size = max(0, len(ids) - n + 1)
    at = np.flatnonzero(doc[:size] == doc[n - 1 :]) if size else np.zeros(0, np.int64)
    h = doc[at].astype(np.uint64) + np.uint64(1)
    for k in range(n):
        h = h * BASE + ids[at + k].astype(np.uint64) + np.uint64(k)
    return at, h


def repetitions(ids: np.ndarray, doc: np.ndarray, lengths: np.ndarray, docs: int, sizes: tuple[int, ...] = (2, 4), long: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Per document the largest share of its words' characters that the occurrences of one n-gram hold (n in `sizes`),
    and the share of words that stand in a run of `long` words met before."""
    upto = np.r_[0, np.cumsum(lengths)]
    whole = np.bincount(doc, lengths, docs)
    best = np.zeros(docs)
    for n in sizes:
        at, h = grams(ids, doc, n)
        if len(at):
            _, first, k = np.unique(h, return_index=True, return_counts=True)
            first, k = at[first[k > 1]], k[k > 1]
            np.maximum.at(best, doc[first], k * (upto[first + n] - upto[first]))
    top = np.minimum(np.divide(best, whole, out=np.zeros(docs), where=whole > 0), 1.0)
    at, h = grams(ids, doc, long)
    edge = np.zeros(len(ids) + 1, np.int64)
    if len(at):
        _, first = np.unique(h, return_index=True)
        again = np.delete(at, first)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + long, -1)
    words = np.bincount(doc, minlength=docs)
    covered = np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=docs)
    return top, np.divide(covered, words, out=np.zeros(docs), where=words > 0)


def _clash_bits(vocabulary: dict[str, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word's number, below `size`, the languages in which it is an article, and those in which none goes before it."""
    first, then = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    for k, (articles, others) in enumerate(CLASHES):
        for bits, words in ((first, articles), (then, others)):
            for w in words.split():
                if w in vocabulary:
                    bits[vocabulary[w]] |= 1 << k
    return first, then


NOTHING = (0, None, None, None, None, None, None, None, None, None, 0.0, False)


def read(texts: Sequence[str | None], common: frozenset[str]) -> list[tuple]:
    """The statistics of SCHEMA behind doc_id, for each of some texts."""
    cut = [_Text(t) for t in texts]
    some = [k for k, c in enumerate(cut) if c.bounds]
    out: list[tuple] = [NOTHING] * len(texts)
    if not some:
        return out
    whole = "\n".join(cut[k].line for k in some)
    begin = np.r_[0, np.cumsum([len(cut[k].line) + 1 for k in some])]
    bounds = np.concatenate([np.asarray(cut[k].bounds) + b for k, b in zip(some, begin, strict=False)])
    kinds = np.concatenate([cut[k].kinds for k in some])
    of = np.repeat(np.arange(len(some)), [len(cut[k].bounds) for k in some])  # the text of each stretch
    edges = np.r_[bounds, begin[-1] - 1]
    code = _classes()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = code == 1
    letters, digits = _sums(letter, edges), _sums(code == 2, edges)
    shown = letter | (code == 2) | (code == 0)
    shown[begin[1:-1] - 1] = False  # the marks between texts
    visible = _sums(shown, edges)
    span = np.diff(np.minimum(edges, np.r_[edges[1:], edges[-1]]))  # characters with the blank behind
    # masked names count neither way
    readable = visible.copy()
    if any(c in whole for c in "█▓■▉_*["):
        for m in MASK.finditer(whole):
            at = np.searchsorted(edges, m.start(), "right") - 1
            readable[at] -= len(m.group()) - m.group().count(" ")
    turn = np.diff(np.r_[np.int8(0), letter.view(np.int8), np.int8(0)])
    start, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    vocabulary: dict[str, int] = {}
    # a word's number is that of its first place among all words
    ids = np.fromiter(map(vocabulary.setdefault, ALPHA.findall(whole), count()), np.int64, len(start))
    lengths = stop - start
    known = np.zeros(len(ids), bool)
    known[[i for w, i in vocabulary.items() if w in common]] = True
    usual = known[ids]
    place = np.searchsorted(bounds, start, "right") - 1  # the stretch of each word
    n = len(bounds)
    number = lambda which: np.bincount(place[which], minlength=n)
    words, usuals, short = np.bincount(place, minlength=n), number(usual), number(lengths < 4)
    kinds_used = _distinct(place[usual], ids[usual], n)
    two = (kinds_used == 2) & (words > 14)
    asked = two[place]
    different = _distinct(place[asked], ids[asked], n)
    # letters prevail, words are whole, and enough different common ones are among them
    marks = readable - letters - digits
    formed = (words > 0) & (letters >= 0.62 * readable) & (digits <= 0.3 * readable) & (marks <= 0.2 * readable)
    enough = (usuals >= 0.1 * words) & (kinds_used >= np.where(words > 14, 3, np.where(words > 6, 2, 1)))
    # languages without a word list show few of the words, but as many short ones as others
    foreign = (short >= 0.3 * words) & (different >= 0.66 * words) & (digits < 0.1 * readable) & (marks < 0.08 * readable)
    running = formed & np.where(two, foreign, enough) & (kinds == 0)
    # words in no order, judged over the stretches around
    first, then = _clash_bits(vocabulary, len(ids))
    beside = (start[1:] - stop[:-1] == 1) & (place[1:] < n) & (of[place[1:]] == of[place[:-1]]) if len(ids) else np.zeros(0, bool)
    articles = np.bincount(place[:-1][beside & (first[ids[:-1]] > 0)], minlength=n) if len(ids) else np.zeros(n, np.int64)
    clashing = np.bincount(place[:-1][beside & (first[ids[:-1]] & then[ids[1:]] > 0)], minlength=n) if len(ids) else np.zeros(n, np.int64)
    lo = np.maximum(np.arange(n) - CLASH_REACH, np.searchsorted(of, of, "left"))
    hi = np.minimum(np.arange(n) + CLASH_REACH + 1, np.searchsorted(of, of, "right"))
    around = lambda x: (lambda t: t[hi] - t[lo])(np.r_[0, np.cumsum(x)])
    jumbled = (around(clashing) >= CLASH_COUNT) & (around(clashing) >= CLASH_SHARE * around(articles))
    running &= ~jumbled
    docs = len(some)
    total = lambda x: np.bincount(of, x, docs)
    prose, counted = total(np.where(running, span, 0)), total(np.where(kinds < 2, span, 0))
    share = np.divide(prose, counted, out=np.zeros(docs), where=counted > 0)
    seen, n_words, all_letters = total(visible), total(words).astype(int), total(letters)
    d_digits, d_usual, marks = total(digits), total(usuals), seen - all_letters - total(digits)
    top, again = repetitions(ids, of[place], lengths, docs) if len(ids) else (np.zeros(docs), np.zeros(docs))
    for j, k in enumerate(some):
        c, w = cut[k], int(n_words[j])
        repeats = c.copies > COPIES or c.paragraphs > PARAGRAPHS or top[j] >= GRAM and again[j] >= AGAIN
        out[k] = (
            w, all_letters[j] / w if w else None, marks[j] / seen[j], d_digits[j] / seen[j], c.ends, d_usual[j] / w if w else 0.0,
            c.copies, c.paragraphs, float(top[j]), float(again[j]), float(share[j]), bool(w and share[j] >= 0.5 and not repeats),
        )
    return out


def statistics(text: str | None, common: frozenset[str]) -> tuple:
    """The statistics of SCHEMA behind doc_id, for one text."""
    return read([text], common)[0]


def repetition(found: list[str]) -> tuple[float, float]:
    """`repetitions` of one list of words."""
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int64)
    top, again = repetitions(ids, np.zeros(len(ids), np.int64), np.array([len(w) for w in found], np.int64), 1)
    return float(top[0]), float(again[0])


def _court(head: list[str]) -> bool:
    """Whether a block of lines looks like the heading of a ruling: short lines, no sentence or table, a number or year."""
    return all(len(t) < 70 and not t.endswith((".", ";")) and "|" not in t and "\t" not in t for t in head) and any(map(YEAR.search, head))


def text_statistics(documents: DataFrame, common_words: DataFrame, most_words: int = 100_000) -> DataFrame:
    """Statistics of every document (see SCHEMA): one row for each row with a doc_id.

    `common_words` (word) holds for all languages together, as lang can't be relied on; it is broadcast and must not
    have more than `most_words` rows (ValueError). Null, empty and blank texts have no words: n_words is 0, the shares
    are null, prose_share is 0 and is_prose false. Texts are read whole. Equal texts have equal statistics. An empty
    table gives no rows; extra columns are ignored."""
    some = common_words.select(F.lower("word").alias("w")).where("w is not null").distinct().limit(most_words + 1).toPandas()["w"]
    if len(some) > most_words:
        raise ValueError(f"more than {most_words} common words")
    common = frozenset(plain(w) for w in some)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].to_list()
            size = np.cumsum([len(t or "") for t in texts]) // TOGETHER
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size)) + 1):
                rows = [(ids[k], *r) for k, r in zip(some, read([texts[k] for k in some], common), strict=True)]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({c: "float64" for c in names if c not in ("doc_id", "n_words", "is_prose")})

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, SCHEMA)


def not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id of every document that isn't natural prose, distinct."""
    return text_statistics(documents, common_words).where(~F.col("is_prose")).select("doc_id").distinct()
