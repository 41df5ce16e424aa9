"""Fuzzy line deduplication.

Lines are normalised (A-Z lower-cased, ASCII punctuation dropped, white space runs one
space) and hashed in one Arrow pass that sends on a few numbers for each line, not its
text. Equal normalised lines are one class. Lines of at least MIN_WORDS words get a
SimHash of 128 bits over their words and word pairs, and meet in two ways:

* its BLOCKS blocks of 32 bits are keys: by the pigeonhole principle two SimHashes that
  differ in fewer than BLOCKS bits agree in one block at least;
* lines of edit similarity SIMILARITY differ in far more bits (17 at the median). They
  keep stretches of text untouched, so WINDOWS further keys are each the least hash of
  the line's windows: runs of words that start at any word and go on until they hold a
  quarter of the line's letters, at least WINDOW[0] and at most WINDOW[1] bytes.

Pairs that share a key are screened by length and by SimHash distance (SCREEN bits), and
verified by edit similarity of the normalised lines. Of each connected group the first
occurrence (smallest doc_id, then line) is kept; the others are cut out of their
documents. A line goes as an exact repeat only where two independent 64-bit hashes agree.

Cases: a null text stays null and has no lines; a row with a null doc_id stays as it is
and has no part in any group; lines of fewer words than the floor (MIN_WORDS by default)
are always kept; with a lower floor lines of fewer than MIN_WORDS words go where they are
repeated exactly in normal form; a document may lose all its lines and is then the empty
text; of repeated rows with one doc_id the first line of either counts as first, and all
rows of that doc_id are edited alike; extra columns are carried through unchanged, except
one named n_removed, which the result's own replaces; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.llm.linking import BLOCK_ROWS, connected_components, dealt_blocks, link_buckets
from orbitile.llm.shared import materialize, packed
from orbitile.llm.textbytes import LOWER, WHITESPACE, Words, mix, simhash, span_hashes, sums_between, text_slices

MIN_WORDS = 5
#: Blocks of the SimHash that are keys, and keys from windows of the line.
BLOCKS, WINDOWS = 4, 8
#: Bytes of words that a window holds: a quarter of the line's, within these limits.
WINDOW = (8, 16)
#: Differing bits of 128 beyond which a pair is not verified: lines of up to SCREEN_CHARS
#: characters, and longer ones, whose many features make the bits more exact.
SCREEN, SCREEN_CHARS, LONG_SCREEN = 40, 150, 34
#: Least edit similarity, 1 - distance / longer length, of a fuzzy pair.
SIMILARITY = 0.8

#: Bytes of texts whose lines are hashed at a time: their arrays stay in memory that is used again.
LINE_BYTES = 1 << 16
#: Texts whose lines are normalised at a time.
FORM_ROWS = 500
#: Pairs of a block that are verified at a time; what they link is not verified again.
PAIRS_AT_ONCE = 20_000
#: Least bytes of a word that counts for the SimHash by itself.
TELLING = 5
#: Characters of a line from which on fixed words and shared runs of letters are tried before
#: the whole distance: pairs that are likely alike, and pairs that are not.
LONG, VERY_LONG = 600, 3000
#: Characters of a stretch between fixed words from which on it is compared by fixed words of its own, and how often over.
STRETCH, DEPTH = 200, 20
#: Fixed words are tried on this many long pairs, and further while a third of those tried are alike.
TRIED = 30
#: A step of numpy over the words of many pairs costs as much as so many words; a step over
#: one pair's Python integers costs BIG_STEP words, and one more for each BIG_BITS rows.
NUMPY_STEP, BIG_STEP, BIG_BITS = 1200, 50, 60

#: Bits of the filter of wanted keys: this many a key, and at most so many in all (8 MB).
FILTER_BITS, MOST_BITS = 8, 1 << 26

#: ASCII punctuation, dropped from lines (fixed values).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DROPPED = np.zeros(256, bool)
_DROPPED[[ord(c) for c in PUNCTUATION]] = True


def window_hashes(words: Words, line_of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows in line order and the first of each line; a line without one is its own window."""
    upto = np.concatenate([[0], np.cumsum(words.end - words.start)])
    size = np.clip((upto[at[1:]] - upto[at[:-1]]) // 4, *WINDOW)
    last = np.searchsorted(upto[1:], upto[:-1] + size[line_of])
    last = np.minimum(last, at[1:][line_of] - 1)  # the rest of the line where that is shorter
    full = upto[last + 1] - upto[:-1] >= size[line_of]
    begin = np.flatnonzero(full | (np.arange(len(line_of)) == at[:-1][line_of]))
    return span_hashes(words.hashes, begin, last[begin] + 1), np.searchsorted(begin, at)


def line_rows(body: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """For all lines of a slice: text, number in the text, id, check, words, SimHash, characters and keys."""
    drop = _DROPPED[body]
    offsets = offsets - np.searchsorted(np.flatnonzero(drop), offsets)
    body = body[~drop]
    newline = np.flatnonzero(body == 10)
    owner = np.searchsorted(offsets, newline, side="right") - 1
    # each text has a line more than it has newlines
    lines = np.bincount(owner, minlength=len(offsets) - 1) + 1
    first_line = np.concatenate([[0], np.cumsum(lines)])
    words = Words(body, offsets, ~WHITESPACE, LOWER)
    # of lines that begin at one place all but the last are empty
    at = np.searchsorted(words.start, np.concatenate([np.sort(np.concatenate([offsets[:-1], newline + 1])), [len(body)]]))
    n = np.diff(at)
    line_of = np.repeat(np.arange(len(n)), n)
    some = np.flatnonzero(n > 0)
    ids, check = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(some):
        for out, values in ((ids, words.hashes), (check, mix(words.hashes, 76))):
            out[some] = mix(span_hashes(values, at[some], at[some + 1]) + n[some].astype(np.uint64), 77)
    text = np.repeat(np.arange(len(lines)), lines)
    # characters of the normal form: those that begin in a word, and a space between words
    further = np.flatnonzero((body & 0xC0) == 0x80)
    size = words.end - words.start
    if len(further):
        size = size - np.searchsorted(further, words.end) + np.searchsorted(further, words.start)
    chars = sums_between(size, at) + np.maximum(n - 1, 0)
    # frequent words are short: words of TELLING bytes and pairs that hold one are features, or all words and
    # pairs of a line that has hardly any such word
    telling = words.end - words.start >= TELLING
    telling |= (np.bincount(line_of, telling, len(n)) < 3)[line_of]
    same = np.flatnonzero((line_of[1:] == line_of[:-1]) & (telling[1:] | telling[:-1]))
    pairs = mix(words.hashes[same] * np.uint64(3) + words.hashes[same + 1], 78)
    which = np.concatenate([line_of[telling], line_of[same]])
    order = np.argsort(which, kind="stable")
    features, first = np.concatenate([words.hashes[telling], pairs])[order], np.searchsorted(which[order], np.arange(len(n) + 1))
    marks = np.stack([simhash(features, first), simhash(mix(features, 80), first)], axis=1)
    keys = np.zeros((len(n), BLOCKS + WINDOWS), np.uint64)
    for block in range(BLOCKS):
        keys[:, block] = mix(marks[:, block // 2] >> np.uint64(32 * (block % 2)) & np.uint64(0xFFFFFFFF), 90 + block)
    hashes, first = window_hashes(words, line_of, at)
    for k in range(WINDOWS):
        keys[:, BLOCKS + k] = mix(sums_between(mix(hashes, 100 + k), first, np.minimum), 100 + k)
    return {"text": text, "line": np.arange(first_line[-1]) - first_line[text], "id": ids, "check": check, "words": n, "marks": marks, "chars": chars, "keys": keys}


LINES = "doc_id long, line int, id long, check long, mark_a long, mark_b long, chars int, keys array<long>"


def _lines(batches, floor: int):
    for batch in batches:
        ids = batch.column(0)
        for i, j, body, offsets in text_slices(batch.column(1), LINE_BYTES):
            rows = line_rows(body, offsets)
            use = rows["words"] >= floor
            long = rows["words"][use] >= MIN_WORDS
            keys = rows["keys"][use][long].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(long * keys.shape[1])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(i, j - i).take(pa.array(rows["text"][use])),
                    pa.array(rows["line"][use].astype(np.int32)),
                    pa.array(rows["id"][use].view(np.int64)),
                    pa.array(rows["check"][use].view(np.int64)),
                    *[pa.array(np.ascontiguousarray(rows["marks"][use, k]).view(np.int64)) for k in (0, 1)],
                    pa.array(rows["chars"][use].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())),
                ],
                ["doc_id", "line", "id", "check", "mark_a", "mark_b", "chars", "keys"],
            )


_TO_NORMAL = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def normal_form(line: bytes) -> bytes:
    """The normal form of a line, the same as the Arrow pass hashes."""
    return b" ".join(line.translate(_TO_NORMAL, PUNCTUATION.encode()).split())


def _forms(batches):
    """(id, form) of the lines at ``places`` of each text; a number beyond the text's lines has none.

    Rows of one doc_id come to one task, which gives each id once, unless a skewed join is split.
    """
    seen: set[int] = set()
    for batch in batches:
        places = batch.column(1).flatten()
        ids, at = places.field(0).to_pylist(), places.field(1).to_pylist()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)).tolist()
        begin = 0
        for k in range(0, batch.num_rows, FORM_ROWS):
            found, forms = [], []
            for text, end in zip(batch.column(0).slice(k, FORM_ROWS).cast(pa.binary()).to_pylist(), ends[k : k + FORM_ROWS], strict=True):
                lines = [] if text is None else text.split(b"\n")
                for i in range(begin, end):
                    if at[i] < len(lines) and ids[i] not in seen:
                        seen.add(ids[i])
                        found.append(ids[i])
                        forms.append(normal_form(lines[at[i]]).decode())
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(forms, pa.string())], ["id", "form"])


def may_be_alike(a: Column, b: Column) -> Column:
    """Lengths that allow SIMILARITY, and SimHashes within SCREEN bits."""
    apart = F.bit_count(a["mark_a"].bitwiseXOR(b["mark_a"])) + F.bit_count(a["mark_b"].bitwiseXOR(b["mark_b"]))
    longer, shorter = F.greatest(a["chars"], b["chars"]), F.least(a["chars"], b["chars"])
    return (shorter >= longer * SIMILARITY - 1e-6) & (apart <= F.when(longer <= SCREEN_CHARS, SCREEN).otherwise(LONG_SCREEN))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance: shared ends cut off, the rest by bit-parallel dynamic programming.

    Column bit vectors of increments are Python integers, so a character costs a few
    operations on as many bits as the other text is long.
    """
    start, end = 0, 0
    least = min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(diagonal | up) & full, up & diagonal
        distance += bool(rise & last) - bool(fall & last)
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(diagonal | rise)) & full, rise & diagonal & full
    return distance


def shared_grams(a: str, b: str) -> int:
    """Runs of three characters that two texts share, each as often as both hold it."""
    one, two = (Counter(map("".join, zip(t, t[1:], t[2:], strict=False))) for t in (a, b))
    return sum((one & two).values())


def anchored_distance(a: str, b: str, most: int = -1, depth: int = DEPTH) -> int:
    """Distance of two texts when words that both hold once, in one order, are held fast; never too small.

    What lies between such words is first taken for wholly different; it is compared, the
    longest first, until the sum is ``most`` at the utmost. A long stretch is compared by the
    words that its two sides hold once, ``depth`` times over.
    """
    one, two = a.split(" "), b.split(" ")
    seen_a, seen_b = Counter(one), Counter(two)
    where = {w: j for j, w in enumerate(two) if seen_b[w] == 1}
    places = [(i, where[w]) for i, w in enumerate(one) if seen_a[w] == 1 and w in where]
    # the longest run of anchors that rises in both texts
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(places):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [j], [k]
    chain, k = [(len(one), len(two))], ends[-1] if ends else -1
    while k >= 0:
        chain.append(places[k])
        k = back[k]
    total, i, j = 0, 0, 0
    between = []
    for next_i, next_j in reversed(chain):
        if i < next_i and j < next_j:
            x, y = " ".join(one[i:next_i]), " ".join(two[j:next_j])
            if x != y:
                between.append((max(len(x), len(y)), x, y))
                total += between[-1][0]
        elif i < next_i or j < next_j:
            # an empty side lacks the space before the anchor as well
            total += sum(map(len, one[i:next_i])) + sum(map(len, two[j:next_j])) + next_i - i + next_j - j
        i, j = next_i + 1, next_j + 1
    if total > most:
        between.sort(reverse=True)
        for size, x, y in between:
            again = depth and size > STRETCH and (len(x) < len(a) or len(y) < len(b))
            total += (anchored_distance(x, y, -1, depth - 1) if again else edit_distance(x, y)) - size
            if total <= most:
                break
    return total


def alike(a: str, b: str) -> bool:
    """Edit similarity of two normalised lines at least SIMILARITY."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - SIMILARITY) + 1e-9)
    # an edit changes three runs of three characters at most
    if abs(len(a) - len(b)) > most or shared_grams(a, b) < longer - 2 - 3 * most:
        return False
    return longer > LONG and anchored_distance(a, b) <= most or edit_distance(a, b) <= most


def edit_distances(ones: list[str], twos: list[str], most: int | np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of many pairs at once; above ``most``, where given, only that they are above it.

    The bit-parallel dynamic programming of ``edit_distance`` in words of 64 rows. Word w
    computes column t - w in step t, when the word above it has done that column, so a step
    of numpy covers all words of all pairs. Pairs come with like lengths (``_batches_of``), so
    little is computed in vain. With ``most`` (a number, or one for each pair) only words that
    meet the band of so many rows around the diagonal are computed; what lies outside is taken
    for its greatest possible value. Values never fall along a diagonal, so a pair is given up
    once the diagonal of its last cell is above its ``most``.
    """
    rows, cols = (np.array([len(t) for t in side], np.int64) for side in (ones, twos))
    n, words = len(ones), max(1, -(-int(rows.max(initial=0)) // 64))
    if not n:
        return np.zeros(0, np.int64)
    points = np.frombuffer("".join([*ones, *twos]).encode("utf-32-le"), np.uint32)
    found = np.zeros(int(points.max(initial=0)) + 1, bool)
    found[points] = True
    code = (np.cumsum(found) - 1)[points]  # letters by number
    ends = np.cumsum(np.concatenate([rows, cols]))
    none, longest = np.count_nonzero(found), int(cols.max())  # beyond the end: no letter
    # which rows of a word hold a letter; beyond the end none does
    match = np.zeros(words * (none + 1) * n, np.uint64)
    owner = np.repeat(np.arange(n), rows)
    row = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    np.bitwise_or.at(match, ((row >> 6) * (none + 1) + code[: len(owner)]) * n + owner, np.uint64(1) << (row & 63).astype(np.uint64))
    # places in ``match`` of all columns, the last first: those of a step's words stand together
    owner = np.repeat(np.arange(n), cols)
    column = np.arange(len(owner)) - np.repeat(np.cumsum(cols) - cols, cols)
    places = np.full((longest + 2 * words, n), none)
    places[longest + words - 1 - column, owner] = code[ends[n - 1] :]
    places = places * n + np.arange(n)
    of_word = np.arange(words)[:, None] * ((none + 1) * n)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    value = np.repeat(64 * np.arange(1, words + 1, dtype=np.int64)[:, None], n, axis=1)  # at the last row of each word
    risen, fallen = np.ones((words + 1, n), np.uint64), np.zeros((words + 1, n), np.uint64)  # what each word takes from the one above
    band = int(np.max(most)) if most is not None else int(max(rows.max(), longest))
    limit = np.broadcast_to(np.asarray(band if most is None else most, np.int64), n)
    last, bit = np.maximum(rows - 1, 0) >> 6, (np.maximum(rows - 1, 0) & 63).astype(np.uint64)
    done = cols - 1 + last  # the step in which a pair's last cell is computed
    out = np.maximum(rows, cols)  # of pairs whose last cell lies outside the band, or that are given up
    here = np.arange(n)
    one, top = np.uint64(1), np.uint64(63)

    def at_row(word: np.ndarray, bits: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The value at a row of a word, for some pairs: that at the word's end less the steps between."""
        beyond = ~np.uint64(0) << bits << one
        return value[word, of] - np.bitwise_count(up[word, of] & beyond) + np.bitwise_count(down[word, of] & beyond).astype(np.int64)

    def keep(which: np.ndarray) -> None:
        nonlocal here, up, down, value, risen, fallen, places
        here = here[which]
        up, down, value, risen, fallen, places = (np.ascontiguousarray(x[:, which]) for x in (up, down, value, risen, fallen, places))

    keep(np.flatnonzero((rows > 0) & (cols > 0)))
    reached, top_before = min(words - 1, (1 + band) // 65), 0
    for t in range(int(done[here].max(initial=-1)) + 1):
        low, high = max(0, -(-(t - band - 63) // 65)), min(words - 1, t, (t + 1 + band) // 65)
        if high > reached:  # a word that enters the band: the column before, 64 rows more than the word above
            reached = high
            value[high] = value[high - 1] - risen[high].astype(np.int64) + fallen[high].astype(np.int64) + 64
        if low > high:
            break
        w = slice(low, high + 1)
        if low == top_before:
            risen[low], fallen[low] = 1, 0  # the row above the band rises with every column
        top_before = low
        equal = match.take(places[longest + words - 1 - t + low : longest + words - t + high] + of_word[w])
        pv, mv, rise_in, fall_in = up[w], down[w], risen[w], fallen[w]
        across = equal | mv
        equal |= fall_in
        diagonal = equal & pv
        diagonal += pv
        diagonal ^= pv
        diagonal |= equal
        rise = diagonal | pv
        np.invert(rise, out=rise)
        rise |= mv
        fall = pv & diagonal
        rise_out, fall_out = rise >> top, fall >> top
        rise <<= one
        rise |= rise_in
        fall <<= one
        fall |= fall_in
        np.bitwise_or(across, rise, out=pv)
        np.invert(pv, out=pv)
        pv |= fall
        np.bitwise_and(rise, across, out=mv)
        value[w] += rise_out.view(np.int64)
        value[w] -= fall_out.view(np.int64)
        risen[low + 1 : high + 2], fallen[low + 1 : high + 2] = rise_out, fall_out
        ready = np.flatnonzero(done[here] == t)
        if len(ready):
            ready = ready[(last[here[ready]] >= low) & (last[here[ready]] <= high)]
            out[here[ready]] = at_row(last[here[ready]], bit[here[ready]], ready)
        if t & 63 == 63:
            # the cells of this step on the diagonals of the pairs' last cells
            place = t + rows[here] - cols[here]
            word = place // 65
            inside = np.flatnonzero((word >= low) & (word <= high) & (place % 65 < 64) & (done[here] > t))
            over = np.zeros(len(here), bool)
            over[inside] = at_row(word[inside], (place[inside] % 65).astype(np.uint64), inside) > limit[here[inside]]
            left = ~over & (done[here] > t)
            if 4 * np.count_nonzero(left) < 3 * len(here):
                keep(np.flatnonzero(left))
                if not len(here):
                    break
    return out


def common_start(a: str, b: str) -> int:
    """Characters that two texts begin with alike, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def bare(a: str, b: str) -> tuple[str, str]:
    """Two texts without what they begin and end with alike, which leaves their distance as it is."""
    start = common_start(a, b)
    a, b = a[start:], b[start:]
    end = common_start(a[::-1], b[::-1])
    return a[: len(a) - end], b[: len(b) - end]


def _batches_of(sizes: np.ndarray):
    """Places of pairs of like size, so many at a time that their tables stay small."""
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        take = max(64, 4096 // (int(sizes[order[i]]) // 256 + 1))
        part = order[i : i + take]
        part = part[sizes[part] <= max(64, 1.3 * sizes[part[0]])]
        yield part
        i += len(part)


def together(pairs: int, size: int, most: int) -> bool:
    """Whether so many pairs of a size are computed faster at once in numpy than one by one in Python integers."""
    words = min(size, 2 * most + 64) // 64 + 1
    return NUMPY_STEP + words * pairs < pairs * (BIG_STEP + size / BIG_BITS)


def all_alike(ones: list[str], twos: list[str], long: int = LONG) -> np.ndarray:
    """``alike`` for many pairs; fixed words are tried first in lines of more than ``long`` characters."""
    a, b = (np.array([len(t) for t in side], np.int64) for side in (ones, twos))
    longer = np.maximum(a, b)
    most = (longer * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    out = np.abs(a - b) <= most
    open_ = out.copy()
    # long pairs are mostly alike by the words they hold in common, or not by the runs of letters they lack
    tried, found = 0, 0
    for i in np.flatnonzero(out & (longer > long)):
        if longer[i] <= VERY_LONG and tried >= TRIED and 3 * found < tried:
            continue
        tried += 1
        if anchored_distance(ones[i], twos[i], int(most[i])) <= most[i]:
            open_[i] = False
            found += 1
        elif longer[i] > VERY_LONG and shared_grams(ones[i], twos[i]) < longer[i] - 2 - 3 * most[i]:
            out[i] = open_[i] = False
    left = np.flatnonzero(open_)
    cut = [bare(ones[i], twos[i]) for i in left]
    for part in _batches_of(np.array([max(map(len, pair)) for pair in cut], np.int64)):
        at = left[part]
        if together(len(part), max(len(t) for k in part for t in cut[k]), int(most[at].max())):
            distances = edit_distances([cut[k][0] for k in part], [cut[k][1] for k in part], most[at])
        else:
            distances = np.array([edit_distance(*cut[k]) for k in part])
        out[at] = distances <= most[at]
    return out


def _block_links(key, rows):
    """Links that connect different labels of one block, or of two blocks, of a bucket.

    Pairs are screened as ``may_be_alike`` does; one that shares several of the buckets
    compared like this is verified in the first of them only, and one whose labels the
    links so far have connected is not verified at all.
    """
    import pandas as pd

    bucket, low, high = key
    ids, block, chars = (rows[c].to_numpy(np.int64) for c in ("id", "block", "chars"))
    label = np.unique(rows["label"].to_numpy(np.int64), return_inverse=True)[1]
    marks = [rows[c].to_numpy(np.int64).view(np.uint64) for c in ("mark_a", "mark_b")]
    keys = rows["keys"].tolist()
    sizes = np.array([len(k) for k in keys], np.int64)
    ends = np.cumsum(sizes)
    # the keys of each row, the last of them as often as there is room
    table = np.concatenate(keys).astype(np.int64)[np.minimum((ends - sizes)[:, None] + np.arange(sizes.max()), ends[:, None] - 1)]
    forms = rows["form"].tolist()
    one, two = (np.flatnonzero(block == low), np.flatnonzero(block == high)) if low != high else (np.arange(len(ids)),) * 2
    out, waiting, n = [], [], 0

    def verify() -> None:
        """Tries the waiting pairs and joins the labels of those that are alike."""
        nonlocal label, waiting, n
        pairs = np.concatenate(waiting)
        pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
        pairs = pairs[all_alike([forms[i] for i in pairs[:, 0]], [forms[i] for i in pairs[:, 1]], VERY_LONG)]
        over = np.arange(int(label.max()) + 1)

        def top(x: int) -> int:
            while over[x] != x:
                over[x] = over[over[x]]
                x = over[x]
            return x

        for i, j in pairs:
            x, y = top(label[i]), top(label[j])
            if x != y:
                over[max(x, y)] = min(x, y)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        label = np.array([top(x) for x in range(len(over))])[label]
        waiting, n = [], 0

    most = np.iinfo(np.int64).max
    step = max(1, PAIRS_AT_ONCE // max(1, len(two)))
    for part in (one[k : k + step] for k in range(0, len(one), step)):
        apart = sum(np.bitwise_count(m[part, None] ^ m[two]) for m in marks)
        x, y = np.nonzero(apart <= max(SCREEN, LONG_SCREEN))
        apart, x, y = apart[x, y], part[x], two[y]
        shorter, longer = np.minimum(chars[x], chars[y]), np.maximum(chars[x], chars[y])
        fit = (shorter >= longer * SIMILARITY - 1e-6) & (apart <= np.where(longer <= SCREEN_CHARS, SCREEN, LONG_SCREEN)) & (label[x] != label[y])
        if low == high:
            fit &= ids[y] > ids[x]
        x, y = x[fit], y[fit]
        shared = (table[x][:, :, None] == table[y][:, None, :]).any(axis=2)
        first = np.where(shared, table[x], most).min(axis=1, initial=most) == bucket
        if first.any():
            waiting.append(np.stack([x[first], y[first]], axis=1))
            n += int(first.sum())
        if n >= PAIRS_AT_ONCE:
            verify()
    if waiting:
        verify()
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])


def _alike(batches):
    for batch in batches:
        keep = pc.and_(pc.is_valid(batch.column("form_a")), pc.is_valid(batch.column("form_b")))
        batch = batch.filter(keep)
        mask = pa.array(all_alike(batch.column("form_a").to_pylist(), batch.column("form_b").to_pylist()), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def _rows_of_keys(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, id) of the lines, without most of the keys that are not ``wanted(key)``.

    A bit for each hash of a wanted key, in a broadcast of bounded size, spares the shuffle
    the other keys. It only ever lets too many pass: the caller joins with ``wanted``.
    """
    sc = lines.sparkSession.sparkContext
    size = min(MOST_BITS, 1 << max(10, int(FILTER_BITS * wanted.count()).bit_length()))
    # a key is mixed bits already
    spot = F.col("key").bitwiseAND(size - 1)
    found = wanted.groupBy(F.shiftright(spot, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(key & 63))")).alias("bits"))
    table = found.toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    shared = sc.broadcast(bits)

    def pick(batches):
        bits = shared.value
        for batch in batches:
            of = batch.column(1)
            keys, ends = of.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(of), 0).to_numpy(zero_copy_only=False))
            spot = keys & (size - 1)
            hit = np.flatnonzero(bits[spot >> 6] >> (spot & 63) & 1)
            row = np.searchsorted(ends, hit, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), batch.column(0).take(pa.array(row))], ["key", "id"])

    return lines.select("id", "keys").mapInArrow(pick, "key long, id long")


def repeated_lines(docs: DataFrame, floor: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lines array<int>): the numbers of the lines that go, for documents losing any."""
    floor = max(floor, 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    lines = materialize(rows.mapInArrow(lambda batches: _lines(batches, floor), LINES), "lines")
    same = [F.min(c).alias(c) for c in ("check", "mark_a", "mark_b", "chars")]
    classes = lines.groupBy("id").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n"), *same)
    classes = materialize(classes, "line-classes")
    # lines of fewer than MIN_WORDS words have no keys and are linked by nothing but equal form
    keys = lines.select("id", F.explode("keys").alias("key"))

    ready: list[DataFrame] = []

    def prepare(ids: DataFrame):
        """The normal forms of the lines that share a key, all of a document taken from its text at once."""
        places = classes.join(ids, "id").select("id", "first.doc_id", "first.line")
        of_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("id", "line")).alias("places"))
        # neither side has a bound, whatever the estimates say: the plan is the same at every size
        found = rows.join(of_doc.hint("shuffle_hash"), "doc_id").select("text", "places").mapInArrow(_forms, "id long, form string")
        forms = materialize(found, "line-forms")
        ready.append(forms)

        def verify(pairs: DataFrame) -> DataFrame:
            full = pairs.join(forms.select(F.col("id").alias("a"), F.col("form").alias("form_a")), "a")
            full = full.join(forms.select(F.col("id").alias("b"), F.col("form").alias("form_b")), "b")
            return full.select("a", "b", "form_a", "form_b").mapInArrow(_alike, "a long, b long")

        return verify

    sigs = classes.select("id", F.struct("mark_a", "mark_b", "chars").alias("sig"))

    def compare(left: DataFrame) -> DataFrame:
        own = left.groupBy("id").agg(F.collect_list("key").alias("keys")).join(ready[0].filter("form is not null"), "id")  # BLOCKS + WINDOWS keys at most
        whole = dealt_blocks(left, F.lit(1), BLOCK_ROWS).select("key", "low", "high", "block", "id", "label", "sig.*").join(own, "id")
        return whole.groupBy("key", "low", "high").applyInPandas(_block_links, "a long, b long")

    linked = link_buckets(keys, sigs, may_be_alike, prepare, compare, narrow=lambda wanted: _rows_of_keys(lines, wanted))
    # a class of one line that is linked with nothing loses none
    named = classes.join(linked, "id", "left").filter("n > 1 or component is not null").select("id", "check", "first", "n", F.coalesce("component", "id").alias("component"))
    named = materialize(named, "line-named")
    # only groups with more than one occurrence lose lines
    heads = named.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).filter("n > 1")
    affected = materialize(named.join(heads.select("component", "keep"), "component").select("id", "check", "keep"), "line-affected")
    gone = lines.select("doc_id", "line", "id", "check").join(affected.hint("shuffle_hash"), ["id", "check"]).filter("doc_id <> keep.doc_id or line <> keep.line")
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def line_dedup(docs: DataFrame, floor: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated lines of at least ``floor`` words cut from ``text``; adds n_removed."""
    gone = materialize(repeated_lines(docs, floor), "gone").select(F.col("doc_id").alias("id"), F.col("lines").alias("gone"))
    out = packed(docs).join(gone.hint("shuffle_hash"), "id", "left")
    # the split text is bound to a name, so that it is split once
    left = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone"))
    cut = F.get(F.transform(F.array(F.split("row.text", "\n", -1)), lambda ls: F.array_join(F.transform(left(ls), lambda i: F.get(ls, i)), "\n")), F.lit(0))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(cut)
    columns = [text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != "n_removed"]
    return out.select(*columns, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
