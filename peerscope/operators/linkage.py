"""Tiered record linkage: facilities to a directory, scoped by board.

Tiers run from certain to loose and stop at the first with candidates; one candidate is a match,
several are listed for review. Work happens once per distinct (board, name, address, city), not per
facility. The similarity tiers score only couples of names that provable bounds of the ratio leave
open; those bounds are compared by bits, tile by tile, and no couple below the threshold is ever a
row (see ``similar_name_pairs``).
"""

from __future__ import annotations

import os
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerscope.functions.text import board_key, fold, normalize_address, normalize_school_name
from peerscope.session import materialize, spread

# --- fixed values: thresholds and tier confidences ------------------------------------------------
SIMILAR_MIN = 0.9
SIMILAR_MARGIN = 0.05
FUZZY_MIN = 0.75
FUZZY_CANDIDATES = 3
CONFIDENCE = {"override": 1.0, "exact_name_board": 1.0, "address_board": 0.95, "name_city_board": 0.85, "fuzzy": 0.5}


#: Cells of pairs of characters that are compared side by side; a longer couple of texts is one step of its own.
CELLS = 1 << 22
#: Characters of a text that are bits of one number.
BITS = 64
#: From this length on the ratio leaves out frequent characters of the second text as anchors (a fixed value of its definition).
FREQUENT_FROM = 200


def _coded(texts: list[str], pad: int) -> np.ndarray:
    """The code points of texts, one row each, filled up with a number that is no character."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), max(1, int(lengths.max(initial=0)))), pad, dtype=np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return out


def _longest_blocks(same: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """(size, start in a, start in b) of the longest common block of each rectangle (a from, a to, b from, b to); the first in a, then in b."""
    i, j = np.arange(same.shape[1]), np.arange(same.shape[2])
    within = (j >= spans[:, 2:3]) & (j < spans[:, 3:4])
    best, run = np.zeros((len(spans), 3), dtype=np.int64), np.zeros((len(spans), len(j) + 1), dtype=np.int16)
    for row in i:
        fits = same[:, row] & within & ((row >= spans[:, 0]) & (row < spans[:, 1]))[:, None]
        run[:, 1:] = np.where(fits, run[:, :-1] + 1, 0)
        at = run.argmax(axis=1)
        size = run[np.arange(len(run)), at]
        longer = size > best[:, 0]
        best[longer] = np.column_stack([size, row + 1 - size, at - size])[longer]
    return best


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in common blocks: the longest block of both texts, then the same to its left and to its right, for all couples side by side."""
    same = _coded(a, -1)[:, :, None] == _coded(b, -2)[:, None, :]
    pair = np.arange(len(a))
    spans = np.column_stack([np.zeros_like(pair), [len(x) for x in a], np.zeros_like(pair), [len(x) for x in b]]).astype(np.int64)
    total = np.zeros(len(a), dtype=np.int64)
    while len(pair):
        size, i, j = _longest_blocks(same[pair], spans).T
        np.add.at(total, pair, size)
        left, right = spans.copy(), spans.copy()
        left[:, 1], left[:, 3], right[:, 0], right[:, 2] = i, j, i + size, j + size
        pair, spans = np.concatenate([pair, pair]), np.concatenate([left, right])
        open_ones = (np.concatenate([size, size]) > 0) & (spans[:, 0] < spans[:, 1]) & (spans[:, 2] < spans[:, 3])
        pair, spans = pair[open_ones], spans[open_ones]
    return total


def _longest_runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``_longest_blocks`` for whole rectangles whose rows are bits of b: runs grow by one character a step, all at once."""
    size, i, j = (np.zeros(len(rows), dtype=np.int64) for _ in range(3))
    live, ends, one = np.flatnonzero(rows.any(axis=1)), rows, rows.dtype.type(1)
    rows = ends = rows[live]
    k = 0
    while len(live):
        k += 1
        longer = np.zeros_like(ends)
        np.bitwise_and(ends[:, :-1] << one, rows[:, 1:], out=longer[:, 1:])
        goes_on = longer.any(axis=1)
        over, last = live[~goes_on], ends[~goes_on]
        at = (last != 0).argmax(axis=1)
        bits = last[np.arange(len(last)), at]
        size[over], i[over], j[over] = k, at - (k - 1), np.bitwise_count((bits & (~bits + one)) - one).astype(np.int64) - (k - 1)
        live, rows, ends = live[goes_on], rows[goes_on], longer[goes_on]
    return size, i, j


def _matched_in_bits(a: list[str], b: list[str]) -> np.ndarray:
    """``_matched`` for texts b of ``BITS`` characters at most: a row of a rectangle is a number."""
    one, two = _coded(a, -1), _coded(b, -2)
    width = 32 if two.shape[1] <= 32 else 64
    kind = np.uint32 if width == 32 else np.uint64
    same = np.zeros((len(a), one.shape[1], width), dtype=bool)
    np.equal(one[:, :, None], two[:, None, :], out=same[:, :, : two.shape[1]])
    same = np.packbits(same, axis=2, bitorder="little").view(kind)[:, :, 0]
    pair, total, full = np.arange(len(a)), np.zeros(len(a), dtype=np.int64), ~kind(0)
    i0, i1, j0, j1 = np.zeros_like(pair), np.fromiter(map(len, a), np.int64, len(a)), np.zeros_like(pair), np.fromiter(map(len, b), np.int64, len(b))
    while len(pair):
        within = (full >> (width - j1).astype(kind)) & (full << j0.astype(kind))  # 0 <= j0 < j1 <= width
        at = i0[:, None] + np.arange((i1 - i0).max())
        rows = np.where(at < i1[:, None], same[pair[:, None], np.minimum(at, same.shape[1] - 1)] & within[:, None], kind(0))
        size, i, j = _longest_runs(rows)
        i += i0
        np.add.at(total, pair, size)
        found = size > 0
        pair, size, i, j, i0, i1, j0, j1 = (x[found] for x in (pair, size, i, j, i0, i1, j0, j1))
        pair, i0, i1, j0, j1 = (np.concatenate(x) for x in ((pair, pair), (i0, i + size), (i, i1), (j0, j + size), (j, j1)))
        wide = (i0 < i1) & (j0 < j1)
        pair, i0, i1, j0, j1 = (x[wide] for x in (pair, i0, i1, j0, j1))
    return total


def ratios(a: pd.Series, b: pd.Series, at_least: float = 0.0) -> np.ndarray:
    """Ratcliff-Obershelp ratios of couples of texts; those below ``at_least`` are 0."""
    lengths = np.column_stack([np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)])
    total, matched = lengths.sum(axis=1), np.zeros(len(a), dtype=np.int64)
    possible = (2 * lengths.min(axis=1) >= total * at_least) & (lengths.min(axis=1) > 0)
    usual = np.flatnonzero(possible & (lengths[:, 1] < FREQUENT_FROM))
    usual = usual[np.argsort(lengths[usual].max(axis=1), kind="stable")]
    one, two = a.to_numpy(), b.to_numpy()
    at = 0
    while at < len(usual):  # as many couples as fit, in the order of their lengths
        sides = np.maximum.accumulate(lengths[usual[at:]], axis=0)
        fit = max(1, int(np.searchsorted(sides[:, 0] * sides[:, 1] * np.arange(1, len(sides) + 1), CELLS, "right")))
        some = usual[at : at + fit]
        by = _matched_in_bits if lengths[some, 1].max() <= BITS else _matched
        matched[some] = by(one[some].tolist(), two[some].tolist())
        at += fit
    for k in np.flatnonzero(possible & (lengths[:, 1] >= FREQUENT_FROM)):
        matched[k] = sum(block.size for block in SequenceMatcher(None, one[k], two[k]).get_matching_blocks())
    with np.errstate(invalid="ignore", divide="ignore"):
        found = np.where(total > 0, 2.0 * matched / total, 1.0)
    return np.where(found >= at_least, found, 0.0)


def _with_words(names: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(the sorted words of each name that has any, as one text; these names)."""
    names = names.dropna().to_numpy()
    texts = np.array([" ".join(sorted(filter(None, name.split(" ")))) for name in names], dtype=object)
    return texts[texts != ""], names[texts != ""]


#: Left names of a block that meet eight times as many right ones in one task; a larger block is cut into tiles, and every tile meets every other side's tile.
TILE = 1 << 14
#: Left names that are compared before their couples are scored, right names whose states are side by side, couples of a name that are scored first.
BATCH, CHUNK, HEAD = 128, 1 << 16, 32
#: Bits that stand for the pairs of adjacent characters of a name.
PAIR_BITS = 512
#: Classes of characters that common subsequences tell apart.
CLASSES = 64
#: More characters than two texts share, in a table of short ones (8 bits).
NEVER = 180
SLACK = 1e-9
PAIRS_SCHEMA = "block string, left_name string, right_name string, score double"


def _numbered(codes: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of all runs of ``width`` characters; repeated ones of a row are told apart by their number, so that sets behave like multisets."""
    row, at = np.nonzero(np.arange(codes.shape[1]) < lengths[:, None] - (width - 1))
    token = codes[row, at].astype(np.int64)
    for k in range(1, width):
        token = (token << 21) | codes[row, at + k]
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    number = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    return row, (token << 21) | np.minimum(number, (1 << 21) - 1)


def _masks(sides: list[tuple[np.ndarray, np.ndarray]], width: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per side (bits of each name's tokens, tokens that share a bit with another one of the name); frequent tokens have bits of their own.

    Two names share no more tokens than bits, plus the tokens that either name lost to shared bits.
    """
    listed = [_numbered(codes, lengths, width) for codes, lengths in sides]
    _, token, count = np.unique(np.concatenate([tokens for _, tokens in listed]), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), dtype=np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    bit, masks, start = rank[token] % bits, [], 0
    for (codes, _), (row, _) in zip(sides, listed, strict=True):
        flags = np.zeros((len(codes), bits), dtype=bool)
        flags[row, bit[start : start + len(row)]] = True
        start += len(row)
        lost = np.bincount(row, minlength=len(codes)) - flags.sum(axis=1)
        masks.append((np.packbits(flags, axis=1).view(np.uint64), lost))
    return masks


class _Subsequences:
    """Upper bounds of the longest common subsequences of left texts with all right texts, bit by bit of the right ones, side by side.

    Texts are read from their ends, in the order of their reversed characters. A left text goes on from the state after the characters that it
    shares with the text before it, and what ends all right texts of a chunk, and the left one, is met at once and takes no bits. Characters
    beyond the ``CLASSES`` most frequent ones share a class with others, and those beyond ``BITS`` are taken as met: both only raise the bound.
    """

    def __init__(self, right: list[str]) -> None:
        turned = [text[::-1] for text in right]
        self.order = np.array(sorted(range(len(right)), key=turned.__getitem__), dtype=np.int64)
        turned = [turned[k] for k in self.order]
        self.lengths = np.fromiter(map(len, turned), np.int64, len(turned))
        self.distinct, self.needs = np.unique(self.lengths), {}
        self.kind = np.uint8 if int(self.lengths.max(initial=0)) + BITS < NEVER else np.int32
        known, count = np.unique(np.frombuffer("".join(turned).encode("utf-32-le", "surrogatepass"), dtype=np.int32), return_counts=True)
        rank = np.empty(len(known), dtype=np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(known))
        self.class_of = {chr(c): int(k) for c, k in zip(known, rank % CLASSES, strict=True)}
        self.classes = min(CLASSES, len(known))
        self.known, self.rank = known, rank % CLASSES
        self.chunks = []
        for start in range(0, len(turned), CHUNK):
            some = turned[start : start + CHUNK]
            ending = os.path.commonprefix([some[0], some[-1]])  # of all between, as they are in order
            self.chunks.append((start, some, ending, {}))

    def _masks(self, some: list[str], skip: int) -> tuple[np.ndarray, int, np.ndarray | None]:
        """(bits of each class in the texts without their last ``skip`` characters, bits, characters of each text that have no bit)."""
        lengths = np.fromiter(map(len, some), np.int64, len(some)) - skip
        codes = _coded([text[skip : skip + BITS] for text in some], 0)
        width = min(BITS, int(lengths.max(initial=0)))
        kind = np.uint16 if width <= 16 else np.uint32 if width <= 32 else np.uint64
        masks = np.zeros((self.classes, len(some)), dtype=kind)
        for at in range(width):
            row = np.flatnonzero(at < lengths)
            masks[self.rank[np.searchsorted(self.known, codes[row, at])], row] |= kind(1 << at)
        beyond = np.maximum(lengths - BITS, 0)
        return masks, width, beyond if beyond.any() else None

    def common(self, turned: list[str], wanted: list[np.ndarray]) -> np.ndarray:
        """For each reversed left text (in order) and each right text in ``order``: a bound of their common subsequence.

        ``wanted`` are the lengths of right texts that each left text asks about; a chunk without any stays 0.
        """
        found = np.zeros((len(turned), -(-len(self.order) // 8) * 8), dtype=self.kind)
        for start, some, ending, kept in self.chunks:
            stacks, lengths = {}, set(self.lengths[start : start + len(some)].tolist())
            for row, text in enumerate(turned):
                if lengths.isdisjoint(wanted[row].tolist()):
                    continue
                skip = len(ending) if text.startswith(ending) else 0
                if skip not in kept:
                    kept[skip] = self._masks(some, skip)
                masks, width, beyond = kept[skip]
                met = [self.class_of[c] for c in text[skip:] if c in self.class_of]
                if skip not in stacks:
                    stacks[skip] = [], [np.full(len(some), ~masks.dtype.type(0))], np.empty_like(masks[0])
                before, states, rest = stacks[skip]
                depth = len(os.path.commonprefix([before, met]))
                for at in range(depth, len(met)):
                    if len(states) == at + 1:
                        states.append(np.empty_like(rest))
                    bits, after, mask = states[at], states[at + 1], masks[met[at]]
                    np.bitwise_and(bits, mask, after)
                    np.subtract(bits, after, rest)
                    np.add(bits, after, after)
                    np.bitwise_or(after, rest, after)
                stacks[skip] = met, states, rest
                out = found[row, start : start + len(some)]
                np.subtract(skip + masks.dtype.itemsize * 8, np.bitwise_count(states[len(met)]), out, casting="unsafe")
                if beyond is not None:
                    out += beyond.astype(out.dtype)
        return found


class _OpenCouples:
    """Couples of some left texts, and all right ones, whose bound of the ratio reaches a threshold or more.

    Two texts of lengths a + b = S with ratio >= t match tS/2 characters in order, so they have a common subsequence as long.
    """

    def __init__(self, table: _Subsequences, left: list[str], threshold: float) -> None:
        self.table, self.threshold, self.lengths = table, threshold, [len(text) for text in left]
        self.common = table.common([text[::-1] for text in left], [self._needs(length)[1] for length in self.lengths])

    def _needs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(characters to share with each right text, lengths of right texts that are possible at all, characters to share with those)."""
        table = self.table
        if length not in table.needs:
            two, t = table.distinct, self.threshold
            least = np.maximum(np.ceil((length + two) * (t / 2) - SLACK).astype(np.int64), 0)
            possible = 2 * np.minimum(two, length) >= t * (length + two) - SLACK
            every = np.full(-(-len(table.order) // 8) * 8, NEVER, dtype=table.kind)
            every[: len(table.order)] = np.where(possible, least, NEVER)[np.searchsorted(two, table.lengths)]
            table.needs[length] = every, two[possible], least[possible]
        return table.needs[length]

    def beyond(self, row: int, ratio: float) -> int:
        """How many characters more than for the threshold a ratio takes, at least."""
        _, two, least = self._needs(self.lengths[row])
        more = np.ceil((self.lengths[row] + two) * (ratio / 2) - SLACK).astype(np.int64) - least
        return min(NEVER // 4, max(0, int(more.min(initial=NEVER))))

    def opened(self, row: int, more: int) -> np.ndarray:
        """Which right texts, by their places in the table's order, share ``more`` characters than they must, or still more."""
        return self.common[row] >= self._needs(self.lengths[row])[0] + self.table.kind(more)

    def listed(self, row: int, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, right text, bound of the ratio) of what is opened."""
        eights = np.flatnonzero(opened.view(np.uint64))
        at, inner = np.nonzero(opened.reshape(-1, 8)[eights])
        at = eights[at] * 8 + inner
        length = self.lengths[row]
        most = 2 * np.minimum(self.common[row][at].astype(np.int64), length) / (length + self.table.lengths[at])
        return np.full(len(at), row), self.table.order[at], most

    def couples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _joined([self.listed(row, self.opened(row, 0)) for row in range(len(self.lengths))])


def _joined(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(none, *found, strict=True))


def _open_couples(left: list[str], right: list[str], threshold: float):
    """(positions of some left texts, their couples), batch by batch."""
    if left and right:
        table = _Subsequences(right)
        order = np.array(sorted(range(len(left)), key=[text[::-1] for text in left].__getitem__))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            yield some, _OpenCouples(table, [left[k] for k in some], threshold)


def _share_pairs(left: list[str], right: list[str], threshold: float):
    """Which couples share enough adjacent pairs of characters: M matched ones are in at most S - 2M + 1 blocks, so 1.5tS - S - 1 pairs."""
    sides = [(_coded(texts, 0), np.fromiter(map(len, texts), np.int64, len(texts))) for texts in (left, right)]
    one, two = sides[0][1], sides[1][1]
    (a_pairs, a_gone), (b_pairs, b_gone) = _masks(sides, 2, PAIR_BITS)

    def enough(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        pairs = np.bitwise_count(a_pairs[i] & b_pairs[j]).sum(axis=1, dtype=np.uint16) + np.minimum(a_gone[i], b_gone[j])
        return pairs >= (one[i] + two[j]) * (1.5 * threshold - 1) - 1 - SLACK

    return enough


def _possible(left: list[str], right: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all couples that bounds of their ratio do not rule out, and a bound of each one's ratio."""
    enough, found = _share_pairs(left, right, threshold), []
    for some, table in _open_couples(left, right, threshold):
        i, j, most = table.couples()
        kept = enough(some[i], j)
        found.append((some[i[kept]], j[kept], most[kept]))
    return _joined(found)


def _best_so_far(i: np.ndarray, score: np.ndarray, best: int, size: int) -> np.ndarray:
    """The ``best``-th score of each left text, 0 with fewer."""
    order = np.lexsort((-score, i))
    nth = np.arange(len(i)) - np.searchsorted(i[order], i[order], "left")
    found = np.zeros(size)
    found[i[order][nth == best - 1]] = score[order][nth == best - 1]
    return found


def _best_couples(table: _OpenCouples, scored, best: int, more: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, score) of the couples that reach the ``best``-th score of their left text.

    Those with the greatest bounds are scored first, the others only if their bounds reach the best scores so far. ``more`` holds the
    characters beyond the threshold that left enough couples before.
    """
    rows = range(len(table.lengths))
    reached, found = [], []
    for row in rows:
        at, opened = more[0], table.opened(row, more[0])
        count = np.count_nonzero(opened)
        while at and count < HEAD:
            at -= 1
            opened = table.opened(row, at)
            count = np.count_nonzero(opened)
        more[0] = min(at + (count > 4 * HEAD), NEVER // 4)
        reached.append(at)
        found.append(table.listed(row, opened))
    i, j, most = _joined(found)
    order = np.lexsort((-most, i))
    i, j, most = i[order], j[order], most[order]
    score = np.zeros(len(i))
    first = np.arange(len(i)) - np.searchsorted(i, i, "left") <= 2 * best
    score[first] = scored(i[first], j[first])
    least = _best_so_far(i[first], score[first], best, len(rows))
    later = ~first & (most >= least[i] - SLACK)
    score[later] = scored(i[later], j[later])
    known = first | later
    least = _best_so_far(i[known], score[known], best, len(rows))
    found = [(i[known], j[known], score[known])]
    again = []
    for row in rows:
        at = table.beyond(row, least[row])
        if at < reached[row]:
            x, y, bound = table.listed(row, table.opened(row, at))
            new = (bound >= least[row] - SLACK) & ~np.isin(y, j[known & (i == row)])
            again.append((x[new], y[new], bound[new]))
    x, y, _ = _joined(again)
    found.append((x, y, scored(x, y)))
    i, j, score = _joined(found)
    kept = score >= _best_so_far(i, score, best, len(rows))[i]
    return i[kept], j[kept], score[kept]


def _compared(threshold: float, best: int | None):
    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame(columns=["block", "left_name", "right_name", "score"])]
        (one, left_names), (two, right_names) = (_with_words(side["name"]) for side in (left, right))
        more, enough = [0], _share_pairs(list(one), list(two), threshold) if best is None and len(one) and len(two) else None

        def scored(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return ratios(pd.Series(one[i]), pd.Series(two[j]), threshold)

        for some, table in _open_couples(list(one), list(two), threshold):
            if best is None:
                i, j, _ = table.couples()
                kept = enough(some[i], j)
                i, j = some[i[kept]], j[kept]
                score = scored(i, j)
            else:
                i, j, score = _best_couples(table, lambda i, j, some=some: scored(some[i], j), best, more)
                i = some[i]
            kept = score >= threshold
            found.append(pd.DataFrame({"block": key[0], "left_name": left_names[i[kept]], "right_name": right_names[j[kept]], "score": score[kept]}))
        found = [x for x in found if len(x)] or found
        return pd.concat(found, ignore_index=True)

    return compare


def similar_name_pairs(left: DataFrame, right: DataFrame, threshold: float, best: int | None = None, tile: int = TILE) -> DataFrame:
    """All (block, left_name, right_name, score) with score >= threshold inside equal blocks.

    ``best`` leaves out couples with a smaller score than that many others of their left name; equal scores stay.

    Inputs have columns block and name (normalised). Couples are never rows of a table: names of a block meet in tiles of about ``tile`` left
    and eight times as many right ones, each pair of tiles is a group of its own, and bounds of the ratio (``_open_couples``) rule out nearly all couples by bits.
    """

    # names without words are left out where they are compared: a filter here would be moved to where the names are made, and make them twice
    lefts, rights = (materialize(side.select("block", "name").filter("block is not null").distinct()) for side in (left, right))
    # blocks with several tiles: at most rows / tile of them
    counts = lefts.select("block", F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(rights.select("block", F.lit(0), F.lit(1)))
    tiles = counts.groupBy("block").agg(*[F.ceil(F.sum(c) / n).cast("int").alias(c) for c, n in (("l", tile), ("r", 8 * tile))]).filter("l > 1 or r > 1")
    tiles = F.broadcast(materialize(tiles))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        of = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
        placed = side.join(tiles, "block", "left").withColumn(f"_{own}", F.pmod(F.xxhash64("name"), of(own)).cast("int"))
        copies = placed.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), of(other) - 1)))
        return spread(copies.select("block", "name", "_l", "_r"), "block", "_l", "_r")

    keys = ["block", "_l", "_r"]
    met = dealt(lefts, "l", "r").groupBy(*keys).cogroup(dealt(rights, "r", "l").groupBy(*keys))
    return met.applyInPandas(_compared(threshold, best), PAIRS_SCHEMA)


def board_lookup(boards: DataFrame) -> DataFrame:
    """(key, board_number): a key shared by two boards resolves to none."""
    return (
        boards.groupBy(board_key(F.col("name")).alias("key"))
        .agg(F.min("board_number").alias("board_number"), F.max("board_number").alias("_other"))
        .filter("board_number = _other")
        .drop("_other")
    )


def resolve_boards(organizations: DataFrame, boards: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(organization_name, board_number) per distinct organisation; aliases beat the directory.

    ``aliases`` has organization_name, board_number and line; the last line of a key wins.
    """
    named = organizations.select("organization_name").distinct().withColumn("key", board_key(F.col("organization_name")))
    result = named.join(board_lookup(boards), "key", "left")
    if aliases is not None:
        known = aliases.groupBy(board_key(F.col("organization_name")).alias("key")).agg(
            F.max_by("board_number", "line").alias("_alias")
        )
        result = result.join(known, "key", "left").withColumn("board_number", F.coalesce("_alias", "board_number"))
    return result.select("organization_name", "board_number")


def linkage_keys(df: DataFrame, name: str) -> DataFrame:
    return (
        spread(df, *df.columns)  # the texts are costly, and a few small files would be a few tasks
        .withColumn("_name", normalize_school_name(F.col(name)))
        .withColumn("_address", normalize_address(F.col("street")))
        .withColumn("_city", fold(F.col("city")))
    )


def _first_schools(directory: DataFrame, keys: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("school_number")
    return directory.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def _exact(profiles: DataFrame, directory: DataFrame, keys: list[str], method: str) -> DataFrame:
    found = directory.groupBy(*keys).agg(
        F.min("school_number").alias("school_number"), F.count("*").alias("candidate_count")
    )
    return profiles.join(found, keys).select(
        *profiles.columns,
        F.when(F.col("candidate_count") == 1, F.col("school_number")).alias("school_number"),
        "candidate_count",
        F.lit(method).alias("method"),
        F.concat_ws("|", F.lit(method), *keys).alias("candidate_group"),
    )


def _ranked(profiles: DataFrame, directory: DataFrame, keys: list[str], threshold: float, keep: int) -> DataFrame:
    """The best ``keep`` schools per distinct profile key and name."""
    block = F.concat_ws("|", *keys)
    pairs = similar_name_pairs(
        profiles.select(block.alias("block"), F.col("_name").alias("name")),
        directory.select(block.alias("block"), F.col("_name").alias("name")),
        threshold,
        keep,
    )
    schools = _first_schools(directory.withColumn("block", block), ["block", "_name"], keep).select(
        "block", F.col("_name").alias("right_name"), "school_number", F.col("name").alias("school_name")
    )
    best = Window.partitionBy("block", "left_name").orderBy(F.desc("score"), "school_number")
    return (
        pairs.join(schools, ["block", "right_name"])
        .withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= keep)
    )


def similar_in_city(profiles: DataFrame, directory: DataFrame) -> DataFrame:
    """Accepted candidates (one, or two that are too close) per block and name."""
    top = _ranked(profiles, directory, ["board_number", "_city"], SIMILAR_MIN - SIMILAR_MARGIN, 2)
    pair = Window.partitionBy("block", "left_name")
    best, second = F.max("score").over(pair), F.min("score").over(pair)
    close = (F.count("*").over(pair) > 1) & (best - second < SIMILAR_MARGIN)
    return (
        top.withColumn("_best", best)
        .withColumn("_close", close)
        .filter((F.col("_best") >= SIMILAR_MIN) & ((F.col("position") == 1) | F.col("_close")))
        .drop("_best", "_close")
    )


def fuzzy_in_board(profiles: DataFrame, directory: DataFrame) -> DataFrame:
    """Up to three review candidates per board and name."""
    return _ranked(profiles, directory, ["board_number"], FUZZY_MIN, FUZZY_CANDIDATES)


def _from_ranked(profiles: DataFrame, ranked: DataFrame, keys: list[str], method: str) -> DataFrame:
    summary = ranked.groupBy("block", F.col("left_name").alias("_name")).agg(
        F.count("*").alias("candidate_count"), F.min("school_number").alias("_school")
    )
    single = (F.col("candidate_count") == 1) & F.lit(method != "fuzzy")
    return (
        profiles.withColumn("block", F.concat_ws("|", *keys))
        .join(summary, ["block", "_name"])
        .select(
            *profiles.columns,
            F.when(single, F.col("_school")).alias("school_number"),
            "candidate_count",
            F.lit(method).alias("method"),
            F.concat_ws("|", F.lit(method), "block", "_name").alias("candidate_group"),
        )
    )


def check_overrides(overrides: DataFrame, schools: DataFrame) -> None:
    """Malformed decisions and unknown schools are errors (the decision file is written by hand)."""
    bad = overrides.filter(
        (F.coalesce("facility_key", F.lit("")) == "")
        | ~F.coalesce("decision", F.lit("")).isin("match", "no_match")
        | ((F.col("decision") == "match") & F.col("school_number").isNull())
    )
    unknown = overrides.filter("decision = 'match'").join(schools, "school_number", "left_anti")
    for frame, text in ((bad, "malformed decision"), (unknown, "unknown school in decision")):
        rows = frame.limit(5).collect()
        if rows:
            raise ValueError(f"{text}: {rows}")


def match_facilities(facilities: DataFrame, schools: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates).

    ``facilities``: facility_key, facility_name, street, city, board_number. ``schools``:
    school_number, name, street, city, board_number. Matches carry facility_key, match_status,
    match_method, match_confidence, school_number, candidate_group and candidate_count; candidates
    list the schools of every ambiguous group once, however many facilities share the group.
    """
    # keys are costly to compute and every tier reads them
    directory = materialize(linkage_keys(schools, "name"))
    keyed = materialize(linkage_keys(facilities, "facility_name"))
    profile_keys = ["board_number", "_name", "_address", "_city"]
    profiles = materialize(keyed.filter("board_number is not null").select(*profile_keys).distinct())

    name_keys, address_keys = ["board_number", "_name"], ["board_number", "_address", "_city"]
    by_name = _exact(profiles, directory, name_keys, "exact_name_board")
    left = profiles.join(by_name, profile_keys, "left_anti")
    placed = directory.filter("_address <> ''")
    by_address = _exact(left.filter("_address <> ''"), placed, address_keys, "address_board")
    left = left.join(by_address, profile_keys, "left_anti")
    left = materialize(left)
    near = materialize(similar_in_city(left, directory))
    by_similar = _from_ranked(left, near, ["board_number", "_city"], "name_city_board")
    left = left.join(by_similar, profile_keys, "left_anti")
    loose = materialize(fuzzy_in_board(materialize(left), directory))
    by_fuzzy = _from_ranked(left, loose, ["board_number"], "fuzzy")
    found = by_name.unionByName(by_address).unionByName(by_similar).unionByName(by_fuzzy)

    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    result = keyed.select("facility_key", *profile_keys).join(found, profile_keys, "left")
    status = F.when(F.col("method").isNull(), "unmatched").when(F.col("school_number").isNotNull(), "matched").otherwise("ambiguous")
    matches = result.select(
        "facility_key",
        status.alias("match_status"),
        F.col("method").alias("match_method"),
        F.try_element_at(confidence, F.col("method")).alias("match_confidence"),
        "school_number",
        F.when(status == "ambiguous", F.col("candidate_group")).alias("candidate_group"),
        F.when(status == "ambiguous", F.col("candidate_count")).otherwise(0).cast("long").alias("candidate_count"),
    )
    if overrides is not None:
        decided = overrides.select("facility_key", "decision", F.col("school_number").alias("_school"))
        joined = matches.join(decided, "facility_key", "left")
        given = F.col("decision").isNotNull()
        accepted = F.col("decision") == "match"
        matches = joined.select(
            "facility_key",
            F.when(given, F.when(accepted, "matched").otherwise("rejected")).otherwise(F.col("match_status")).alias("match_status"),
            F.when(given, "override").otherwise(F.col("match_method")).alias("match_method"),
            F.when(given, F.when(accepted, F.lit(1.0))).otherwise(F.col("match_confidence")).alias("match_confidence"),
            F.when(given, F.when(accepted, F.col("_school"))).otherwise(F.col("school_number")).alias("school_number"),
            F.when(~given, F.col("candidate_group")).alias("candidate_group"),
            F.when(given, F.lit(0)).otherwise(F.col("candidate_count")).cast("long").alias("candidate_count"),
        )

    def listed(rows: DataFrame, group: Column, method: str) -> DataFrame:
        return rows.select(
            group.alias("candidate_group"), "school_number", "school_name", F.lit(method).alias("method"),
            F.lit(CONFIDENCE[method]).alias("score"),
        )

    several = matches.filter("match_status = 'ambiguous'").select("candidate_group").distinct()
    named = directory.withColumnRenamed("name", "school_name")
    candidates = (
        listed(named, F.concat_ws("|", F.lit("exact_name_board"), *name_keys), "exact_name_board")
        .unionByName(listed(named, F.concat_ws("|", F.lit("address_board"), *address_keys), "address_board"))
        .unionByName(listed(near, F.concat_ws("|", F.lit("name_city_board"), "block", "left_name"), "name_city_board"))
        .unionByName(listed(loose, F.concat_ws("|", F.lit("fuzzy"), "block", "left_name"), "fuzzy"))
        .join(several, "candidate_group", "left_semi")
    )
    return matches, candidates
