"""Word dictionaries of scripts without spaces, from the ICU library that comes with Spark (``jars/icu4j-*.jar``).

A dictionary is a compact trie in ICU's published data format; words are looked up in the bytes themselves, nothing is unpacked. The driver
reads the file (a few hundred kilobytes, fixed) and sends it with the tasks, so the executors need not have it.
"""

from __future__ import annotations

import glob
import os
import struct
import zipfile

#: Script to the file below ``brkitr/``.
FILES = {"thai": "thaidict.dict", "lao": "laodict.dict"}


def icu_jar(jars: str | None = None) -> str:
    """The library's path: in ``jars``, or where this PySpark, or SPARK_HOME, has its jars. FileNotFoundError if it is nowhere."""
    import pyspark

    places = [jars] if jars else [os.path.join(os.path.dirname(pyspark.__file__), "jars"), os.path.join(os.environ.get("SPARK_HOME", ""), "jars")]
    for place in places:
        if found := sorted(glob.glob(os.path.join(place, "icu4j-*.jar"))):
            return found[-1]
    raise FileNotFoundError(f"no icu4j-*.jar in {places}")


def load(script: str, jars: str | None = None) -> bytes:
    """The bytes of a script's dictionary."""
    with zipfile.ZipFile(icu_jar(jars)) as z:
        name = next(n for n in z.namelist() if n.endswith("/brkitr/" + FILES[script]))
        return z.read(name)


class Trie:
    """Look-up of words in a dictionary of the byte form, whose characters are offsets from a base character.

    A node is a branch over bytes, a run of bytes, or a value (the end of a word), told apart by its first byte. From a branch of many
    bytes one gets to the right part by comparisons, each with a jump for the lower half; a short one lists byte and jump.
    """

    # --- fixed values: first bytes in ICU's byte tries ---
    RUN, VALUE, LIST = 0x10, 0x20, 5  # of a run, of a value; the longest branch that is a list
    VALUE_SIZES, ONE_BYTE = (0x51, 0x6C, 0x7E, 0x7F), 0x10  # where values of two to five bytes begin; that of the value 0
    JUMP_SIZES = (0xC0, 0xF0, 0xFE, 0xFF)  # the same of jumps
    JOINER, NON_JOINER, MOST = 0xFF, 0xFE, 0xFD  # bytes of U+200D and U+200C, and the highest offset
    # --- end of fixed values ---

    def __init__(self, data: bytes):
        big = data[8] == 1
        (head,) = struct.unpack_from(">H" if big else "<H", data)
        index = struct.unpack_from((">" if big else "<") + "8i", data, head)
        kind, transform = index[4] & 7, index[5]
        if kind != 0 or transform >> 24 != 1:
            raise ValueError("not a byte trie over an offset")
        self.base = transform & 0x1FFFFF
        self.data = data[head + index[0] : head + index[3]]

    def _number(self, at: int, lead: int, limits: tuple[int, int, int, int]) -> tuple[int, int]:
        """A number of one to five bytes whose first is ``lead``, and where the next thing starts; limits are the first bytes of each length."""
        d, (two, three, four, five) = self.data, limits
        if lead < two:
            return lead, at
        if lead < three:
            return (lead - two) << 8 | d[at], at + 1
        if lead < four:
            return (lead - three) << 16 | d[at] << 8 | d[at + 1], at + 2
        size = 3 if lead == four else 4
        return int.from_bytes(d[at : at + size], "big"), at + size

    def _value(self, at: int) -> int:
        """Where things go on after the value node at ``at``."""
        lead = self.data[at] >> 1
        return self._number(at + 1, lead, self.VALUE_SIZES)[1]

    def _jump(self, at: int) -> tuple[int, int]:
        """The target of the jump at ``at``, and where things go on without it."""
        delta, end = self._number(at + 1, self.data[at], self.JUMP_SIZES)
        return end + delta, end

    def _branch(self, at: int, length: int, byte: int) -> int:
        """The node behind ``byte`` in a branch of ``length`` bytes, or -1."""
        d = self.data
        while length > self.LIST:
            split, at = d[at], at + 1
            target, after = self._jump(at)
            if byte < split:
                at, length = target, length >> 1
            else:
                at, length = after, length - (length >> 1)
        for left in range(length, 0, -1):
            key, at = d[at], at + 1
            if left == 1:
                return at if key == byte else -1
            if d[at] & 1:  # a value that ends here
                if key == byte:
                    return at
                at = self._value(at)
            else:
                lead = d[at] >> 1
                delta, end = self._number(at + 1, lead, self.VALUE_SIZES)
                if lead < self.VALUE_SIZES[0]:
                    delta -= self.ONE_BYTE
                if key == byte:
                    return end + delta
                at = end
        return -1

    def ends(self, text: str, start: int) -> list[int]:
        """The ends of all words that begin at ``start``."""
        d, at, run, out = self.data, 0, 0, []
        for i in range(start, len(text)):
            byte = self._byte(text[i])
            if byte < 0:
                break
            if run:
                if d[at] != byte:
                    break
                at, run = at + 1, run - 1
            else:
                while d[at] >= self.VALUE:  # passed values of words that go on
                    if d[at] & 1:
                        return out
                    at = self._value(at)
                node, at = d[at], at + 1
                if node < self.RUN:
                    if node == 0:
                        node, at = d[at], at + 1
                    at = self._branch(at, node + 1, byte)
                    if at < 0:
                        break
                else:
                    if d[at] != byte:
                        break
                    at, run = at + 1, node - self.RUN
            if not run and d[at] >= self.VALUE:
                out.append(i + 1)
                if d[at] & 1:
                    break
        return out

    def _byte(self, c: str) -> int:
        if c == "\u200d":
            return self.JOINER
        if c == "\u200c":
            return self.NON_JOINER
        delta = ord(c) - self.base
        return delta if 0 <= delta <= self.MOST else -1
