"""Token-set similarity of two short normalised strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of a row that one long holds, so that a sum of two rows and a carry stays positive.
ROW_BITS = 62


def _letters(string: Column) -> Column:
    return F.split(string, "")


def _places(string: Column, block: Column) -> Column:
    """map<letter, long>: a bit for each place of the letter among the ``ROW_BITS`` letters of ``block``."""
    part = F.substr(string, block * ROW_BITS + 1, F.lit(ROW_BITS))
    letters = F.array_distinct(_letters(part))
    bit = lambda c: F.transform(_letters(part), lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.map_from_arrays(letters, F.transform(letters, lambda c: F.aggregate(bit(c), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))))


def _full(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence.

    Bit-parallel: a bit of the row stands for a letter of the shorter string, and the row is folded over the longer one's letters. A row
    longer than a long lies in several, and the sum carries from one to the next.
    """
    swap = F.char_length(a) > F.char_length(b)
    short, long_ = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    width = F.char_length(short)
    zero = F.lit(0).cast("long")

    def one_long() -> Column:
        # The folded values carry what the steps read, so nothing is worked out once more for each letter.
        start = F.struct(_full(width).alias("row"), _full(width).alias("full"), _places(short, F.lit(0)).alias("places"))

        def step(at: Column, letter: Column) -> Column:
            row, hit = at["row"], at["row"].bitwiseAND(F.coalesce(at["places"][letter], zero))
            return F.struct((row + hit).bitwiseOR(row - hit).bitwiseAND(at["full"]).alias("row"), at["full"].alias("full"), at["places"].alias("places"))

        return F.aggregate(_letters(long_), start, step, lambda at: F.bit_count(at["row"]).cast("int"))

    def several_longs() -> Column:
        blocks = F.sequence(F.lit(0), F.floor((width - 1) / ROW_BITS).cast("int"))
        start = F.transform(blocks, lambda k: F.struct(
            _full(F.least(F.lit(ROW_BITS), width - k * ROW_BITS)).alias("row"),
            _full(F.least(F.lit(ROW_BITS), width - k * ROW_BITS)).alias("full"), _places(short, k).alias("places"),
        ))
        nothing = F.filter(start, lambda x: F.lit(False))

        def step(rows: Column, letter: Column) -> Column:
            def block(done: Column, at: Column) -> Column:
                row, hit = at["row"], at["row"].bitwiseAND(F.coalesce(at["places"][letter], zero))
                total = row + hit + done["carry"]
                changed = total.bitwiseOR(row - hit).bitwiseAND(at["full"])
                return F.struct(
                    F.shiftright(total, ROW_BITS).alias("carry"),
                    F.concat(done["rows"], F.array(F.struct(changed.alias("row"), at["full"].alias("full"), at["places"].alias("places")))).alias("rows"),
                )

            return F.aggregate(rows, F.struct(zero.alias("carry"), nothing.alias("rows")), block, lambda done: done["rows"])

        count = lambda rows: F.aggregate(rows, F.lit(0), lambda n, at: n + F.bit_count(at["row"]).cast("int"))
        return F.aggregate(_letters(long_), start, step, count)

    left_over = F.when(width <= ROW_BITS, one_long()).otherwise(several_longs())
    return F.when(width == 0, 0).otherwise(width - left_over)


def rests(left: Column, right: Column) -> dict[str, Column]:
    """What a score needs of the sorted, distinct word arrays: the width of the shared words and the others as text."""
    return {
        "n_shared": F.length(F.array_join(F.array_intersect(left, right), " ")),
        "only_left": F.array_join(F.array_except(left, right), " "),
        "only_right": F.array_join(F.array_except(right, left), " "),
    }


def rest_ratio(n_shared: Column, only_left: Column, only_right: Column, cutoff: float = 0.0) -> Column:
    """The score from ``rests``, none of the word sets being empty; exact from ``cutoff`` up.

    Word sets where one contains the other score 100 once they share a word;
    otherwise the best normalised insert/delete similarity among
    (shared+left, shared+right), (shared, shared+left) and (shared, shared+right).
    A pair has at least as many inserts and deletes as edits, so strings with too many
    edits to reach ``cutoff`` are left out by the built-in, banded edit distance.
    """
    gap = F.when(n_shared > 0, 1).otherwise(0)
    n_left, n_right = F.length(only_left), F.length(only_right)
    total = 2 * (n_shared + gap) + n_left + n_right
    most = F.floor(total * (100.0 - cutoff) / 100 + 1e-9).cast("int")
    close = F.abs(n_left - n_right) <= most
    near = F.call_function("levenshtein", only_left, only_right, most) >= 0

    def similarity(dist: Column, length: Column) -> Column:
        return 100 - 100.0 * dist / length

    whole = F.when(close & near, similarity(n_left + n_right - 2 * common_subsequence(only_left, only_right), total)).otherwise(0.0)
    to_left = similarity(gap + n_left, 2 * n_shared + gap + n_left)
    to_right = similarity(gap + n_right, 2 * n_shared + gap + n_right)
    contained = (n_shared > 0) & ((n_left == 0) | (n_right == 0))
    return F.when(contained, F.lit(100.0)).otherwise(F.greatest(whole, F.when(n_shared > 0, F.greatest(to_left, to_right))))


def token_set_ratio(left: Column, right: Column, cutoff: float = 0.0) -> Column:
    """0..100 from the sorted, distinct word arrays ``left`` and ``right``; exact from ``cutoff`` up."""
    of = rests(left, right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(rest_ratio(**of, cutoff=cutoff))
