"""Sentence units of mail messages in any language (problem 8).

A message's plain parts are cut into blocks, and each prose block into sentences by the best path through a lattice. In spaced scripts, and in
Chinese and Japanese, its nodes are the terminators with their closing marks: each is a boundary or not, at a score by what stands before
(abbreviation, number, initial), after (case, script) and around it (quotation, bracket), and a unit without a word costs. In Thai
and Lao the words come from a lattice over a general dictionary, and each space is classified by final particles, opening words and
whether a clause with a verb stands on either side. In Chinese and Japanese a quotation goes on if the word after it carries the sentence on.
Khmer, Burmese, Tibetan and the like have marks of their own for the end of a sentence; their spaces are not considered.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm import dictionaries
from tidewell.llm import lexicon as X
from tidewell.llm.mail import lines, plain_parts
from tidewell.session import spread

_MARKS = re.compile(r"(?:[ \t]*[>|])+[ \t]?")
_CAND = re.compile(r"[.!?…。！？｡؟।॥;;։።។။៕།༎]+|(?<=[ऀ-ॿ]) ?\|(?=\s|$)")
_CLOSERS = re.compile(r"(?:[)\]}”’»』」）】〉》]|\"(?=\s|$)|[ \u00a0\u202f]»)+")
_SPAN = re.compile(r"„[^“”„]*[“”]|“[^”“]*”|«[^»«]*»|「[^」「]*」|『[^』]*』|（[^）（]*）|\([^)(]*\)|\"[^\"]*\"|\[[^\]\[]*\]", re.S)
_SKIP = re.compile(r"[\s­​-‏⁠﻿]*")
#: What stands between words without being one: stray marks, symbols and pictures, markup of other systems.
_NOISE = re.compile(r"(?:~+|<\|[^|>\s]*\|>|[\u2600-\u27bf\U0001f000-\U0001faff\u200d\ufe0f]|[\s\u00ad\u200b-\u200f\u2060\ufeff])*")
_RULE = re.compile(r"[\W_]{3,}\Z")
_ORIGINAL = re.compile(r"[-_=]{2,} ?[^\W_].*[-_=]{2,}\s*\Z")
_HEADER = re.compile(r"([^\W\d_][\w-]*) ?[:：]")
_GAP = re.compile(r"\s+")
_MIXED = re.compile(r"[a-z]+[A-Z]")
#: A short capitalised word without a vowel: an abbreviation, before a name most likely a title.
_VOWELLESS = re.compile(r"[BCDFGHJKLMNPQRSTVWXZ][bcdfghjklmnpqrstvwxz]{1,4}")
_DOTTED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]\Z")
_JOINED = re.compile(r"[^\W\d_]+(?:[\s,;:!?…)\"»”]|\.{1,3}(?:\s|$)|$)")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


_NO_WORD = re.compile(r"[^\w-]+")
_STEMS = [(what, weight, [" " + x for x in stems.casefold().split()]) for what, (weight, stems) in X.NOTICE_STEMS.items()]
_STEM_PARTS = [(what, weight, [x.replace("_", " ") for x in parts.split()]) for what, (weight, parts) in X.NOTICE_PARTS.items()]


class Lattice:
    """Words of a dictionary over a text without spaces: the path with the fewest unknown characters, then the fewest words."""

    def __init__(self, words: frozenset[str], trie: dictionaries.Trie | None = None):
        self.words, self.longest, self.trie = words, max(map(len, words), default=0), trie

    def _ends(self, text: str, i: int) -> set[int]:
        found = {j for j in range(i + 1, min(len(text), i + self.longest) + 1) if text[i:j] in self.words}
        if self.trie is not None:
            found.update(j for j in self.trie.ends(text, i) if j > i + 1)  # a letter is no word
        return found

    def path(self, text: str) -> list[str]:
        best: list[tuple[int, int, int]] = [(0, 0, -1)] + [(len(text) + 1, 0, -1)] * len(text)
        for i in range(len(text)):
            unknown, words, _ = best[i]
            best[i + 1] = min(best[i + 1], (unknown + 1, words + 1, i))
            for j in self._ends(text, i):
                best[j] = min(best[j], (unknown, words + 1, i))
        out, j = [], len(text)
        while j:
            i = best[j][2]
            out.append(text[i:j])
            j = i
        return out[::-1]


_CJK_LATTICE = Lattice(X.CJK_CARRY_ON | X.CJK_WORDS)
_TOKEN = re.compile(r"([ก-ฺเ-๎]+)|([ກ-ຽເ-ໝ]+)|(?:(?![ก-๎ກ-ໝ])[^\W_])+|[^\w\s\u00ad\u200b-\u200f\u2060\ufeff]")
_SPACELESS = {"thai": re.compile("[฀-๿]"), "lao": re.compile("[ກ-ໟ]")}
#: The dictionaries' bytes in this process: those that came with the task, else read here when they are first needed.
_raw: dict[str, bytes] = {}
_lattices: dict[str, Lattice] = {}


def _lattice(script: str) -> Lattice:
    if script not in _lattices:
        if script not in _raw:
            _raw[script] = dictionaries.load(script)
        _lattices[script] = Lattice(X.CLAUSES[script].words(), dictionaries.Trie(_raw[script]))
    return _lattices[script]


def _tokens(piece: str, memo: dict) -> list[str]:
    """The words of a piece without spaces, and other tokens as they are."""
    out: list[str] = []
    for m in _TOKEN.finditer(piece):
        if m[1] is None and m[2] is None:
            out.append(m[0])
            continue
        key = ("words", m[0])
        if key not in memo:
            memo[key] = _lattice("thai" if m[1] else "lao").path(m[0])
        out += memo[key]
    return out


def _has_verb(c: X.Clauses, words: list[str], before: str = "") -> bool:
    """Whether the words hold a verb of their own, not one in a noun or in a clause inside; ``before`` is the word before them."""
    for w in words:
        if before not in c.nominal and before not in c.leaning:
            if w in c.light:
                if before and before not in c.verbs and before not in c.light and before not in c.auxiliaries:
                    return True
            elif w in c.verbs or w in c.requests or w in c.auxiliaries:
                return True
        before = w
    return False


def _joins(c: X.Clauses, letter: re.Pattern, last: str, right: list[str]) -> bool:
    """Whether a piece goes on with the one before by its first word, or by the last word of that one."""
    first = right[0]
    if not letter.match(first) or first in c.auxiliaries or first in c.after or first in c.finals:
        return True
    if first in c.ties and not (first in c.things and len(right) > 1 and right[1] in c.qualities):
        return first not in c.leaning
    return last in c.ties and last not in c.trailing


def _parts(c: X.Clauses, letter: re.Pattern, last: str, whole: bool, pieces: list[list[str]], at: int) -> bool:
    """Whether the space before piece ``at`` ends a sentence; ``last`` is its last word so far, ``whole`` if it could end there."""
    right = pieces[at]
    first = right[0]
    if last in c.finals:
        return bool(letter.match(first)) and first not in c.finals and first not in c.after
    if not whole or _joins(c, letter, last, right):
        return False
    clause, k = list(right), at + 1
    while k < len(pieces) and (not pieces[k] or _joins(c, letter, clause[-1], pieces[k])):
        clause += pieces[k]
        k += 1
    if first in c.leaning:  # with the clause after it, if there is one
        return k < len(pieces) and _has_verb(c, pieces[k]) and clause[-1] not in c.finals
    strong = first in c.subjects or first in c.requests
    if last.isdigit() and not strong:  # what is counted
        return False
    if first in c.verbs and not strong and not letter.match(last) and last not in ")]}”\"":  # a name is the subject
        return False
    return len(clause) > 1 and _has_verb(c, clause)


_CJK_RUN = re.compile("[぀-ヿ㐀-鿿]+")


def _carries_on(s: str, at: int) -> bool:
    m = _CJK_RUN.match(s, at)
    return bool(m) and _CJK_LATTICE.path(m.group())[0] in X.CJK_CARRY_ON


def _uncased(c: str) -> bool:
    """A letter without case, or a vowel sign of such a script."""
    return c != "" and c.lower() == c.upper() and (c.isalpha() or category(c)[0] == "M")


def _opens(s: str, at: int) -> bool:
    """Whether a word in lower case at ``at`` is one that sentences begin with."""
    m = _WORD.match(s, at)
    return bool(m) and (m.group() in X.LOWER_OPENERS or _MIXED.match(m.group()) is not None)


def _word_before(s: str, at: int) -> str:
    """The word that ends before the white space at ``at``, whole."""
    while at and s[at - 1].isspace():
        at -= 1
    end = at
    while at and not s[at - 1].isspace():
        at -= 1
    return s[at:end]


#: How sure a rule is: a boundary at a mark that is nothing else, or by case and spacing; against it an abbreviation, or what goes on in lower case.
SURE, LIKELY = 4, 2
#: What a unit without any letter or digit costs.
WORDLESS = 3


def _score(s: str, i: int, mark: str, e: int, inside: tuple[int, int] | None, start: int, word: int, before: str) -> int:
    """The score of a boundary at the terminator ``mark`` at i, closed at e, of a sentence that began at ``start``."""
    sure = SURE if any(c in mark for c in "。！？｡।॥።။។៕།༎") else LIKELY
    return sure if _ends(s, i, mark, e, inside, start, word, before) else -(2 * sure + 1)  # so a wrong one never pays for what it makes of the next


def _ends(s: str, i: int, mark: str, e: int, inside: tuple[int, int] | None, start: int, word: int, before: str) -> bool:
    """Whether that boundary is for or against; the token before the mark begins at ``word``, ``before`` is the last letter before it."""
    n = _SKIP.match(s, e).end()
    if n >= len(s):
        return False
    spaced, nxt = any(c.isspace() for c in s[e:n]), s[n]
    if (far := _NOISE.match(s, n).end()) > n and far < len(s) and spaced:
        n, nxt = far, s[far]
    if nxt in ",;:،；：，、—–" or (nxt in "-" and s[n + 1 : n + 2].isspace()) or nxt in ")]}”»』」）":
        return False
    lower = nxt.islower() and not _opens(s, n)
    if any(c in mark for c in "。！？｡"):
        if inside is None:
            return True
        if _carries_on(s, n):
            return False
        return any(c in mark for c in "。｡") or not s[start : inside[0]].strip()
    if "।" in mark or "॥" in mark or "|" in mark or any(c in mark for c in "።។။៕།༎"):
        return True
    if mark.strip(".…") == "" and (len(mark) > 1 or "…" in mark):  # a pause, unless an upper-case word follows
        return not lower and not _uncased(nxt) and not _CJK.match(nxt) and (spaced or nxt.isupper()) and not (
            _uncased(before) and nxt.isalpha() and not nxt.isupper()
        )
    if mark.strip(";;") == "":
        return "Ͱ" <= before <= "Ͽ" and (not lower or inside is None) and (spaced or nxt.isupper())
    if any(c in mark for c in "!?؟։"):
        if inside is not None:
            if lower or (_uncased(before) and not _SPACELESS["thai"].match(before)):
                return False
            return spaced or nxt.isupper()
        if _MIXED.match(s[max(start, word) : i] or "-"):
            return False
        return spaced or nxt.isupper() or nxt in "¿¡«„“\"(" or _uncased(nxt) and _uncased(before)
    # One full stop.
    if inside is not None:
        return not lower and (spaced or nxt.isupper() or _uncased(nxt))
    token = s[max(start, word) : i].lstrip("­​‌‍⁠﻿'’")
    if not token:
        return spaced and not lower
    upper = nxt.isupper() or nxt in "¿¡«„“\"([" or (not nxt.isalnum() and nxt not in "<&%+/=~") or _opens(s, n)
    if not spaced:
        if e != i + len(mark):
            return nxt.isupper()
        if _uncased(before) and _uncased(nxt):
            return len(token) > 1 and token not in X.NEVER_LAST and not _CJK.match(nxt)
        if not nxt.isupper() or not _JOINED.match(s, n):
            return False
        plain = token.isalpha() and not token.isupper() or token.replace(",", "").replace(".", "").isdigit() or token in X.MAY_BE_LAST or bool(re.search(r"[a-zа-яά-ώ]\)?\Z", token)) and "." not in token and "@" not in token and not re.search(r"\d", token)
        return plain and token not in X.NEVER_LAST and token not in X.BEFORE_NUMBER
    if token.replace(",", "").replace(".", "").isdigit():
        if nxt.isdigit():
            after = re.match(r"\d+\.", s[n:])
            return not after and not (s[i - len(token) - 1 : i - len(token)].isspace() and _word_before(s, i - len(token)) in X.ORDINAL_AFTER)
        if lower:
            return False
        lead = _word_before(s, i - len(token))
        return not (nxt.isalpha() and (lead in X.ORDINAL_AFTER or re.fullmatch(r"\d+\.", lead)))
    if token in X.NEVER_LAST or len(token) == 1 and (token.isupper() or _uncased(token)):
        return False
    if token in X.BEFORE_NUMBER:
        return nxt.isupper()
    if token == "Co" and s.startswith("KG", n):
        return False
    if token in X.MAY_BE_LAST or _DOTTED.match(token):
        return upper
    if "ऀ" <= before <= "ॿ":
        return not lower and len(token) > 2
    return not (_VOWELLESS.fullmatch(token) and nxt.isupper())


def _space_cuts(script: str, s: str, cuts: list[int], spans: list[tuple[int, int]], memo: dict) -> list[int]:
    """The spaces outside quotations that end a sentence of a spaceless script, between the cuts made already."""
    c, letter = X.CLAUSES[script], _SPACELESS[script]
    starts = [a for a, _ in spans]
    out: list[int] = []
    for lo, hi in zip([0, *cuts], [*cuts, len(s)]):
        if not letter.search(s, lo, hi):
            continue
        gaps = [(lo, lo)]
        for g in _GAP.finditer(s, lo, hi):
            k = bisect_right(starts, g.start()) - 1
            if lo < g.start() and g.end() < hi and not (k >= 0 and g.start() < spans[k][1]):
                gaps.append(g.span())
        pieces = [_tokens(s[b:c], memo) for (_, b), (c, _) in zip(gaps, [*gaps[1:], (hi, hi)])]
        last, verb, leaning = "", False, False
        for i, piece in enumerate(pieces):
            if not piece:
                continue
            if last and _parts(c, letter, last, verb and not leaning, pieces, i):
                out.append(gaps[i][0])
                last = ""
            if not last:
                verb, leaning = False, piece[0] in c.leaning
            elif leaning and not _joins(c, letter, last, piece):  # the main clause
                leaning = False
            verb = verb or _has_verb(c, piece, last)
            last = piece[-1]
    return out


_DELIMITER = re.compile(r"[\s\"“”„«»()（）「」\[\],;:]")


def _best_path(s: str, spans: list[tuple[int, int]]) -> list[int]:
    """The boundaries at terminators along the best path, as ends with their closing marks.

    Each candidate is taken or not; the state of the path is where its last boundary lies. A boundary's score depends on the text since then,
    and a unit without a word costs, so a weak boundary may make room for a better one beside it.
    """
    starts = [a for a, _ in spans]
    # (score, boundaries as a linked list) of the best path that has a boundary at the last candidate, and of the best that has none there
    taken: tuple[int, tuple] | None = None
    passed: tuple[int, tuple] = (0, ())
    seen, word, before = 0, 0, ""  # up to where the text was looked at, where its last token begins, its last letter
    for m in _CAND.finditer(s):
        i, e = m.span()
        for d in _DELIMITER.finditer(s, seen, i):
            word = d.end()
        for k in range(i - 1, seen - 1, -1):
            if s[k].isalpha() or "ऀ" <= s[k] <= "ॿ":
                before = s[k]
                break
        seen = i
        inside = None
        k = bisect_right(starts, i) - 1
        if k >= 0 and i < spans[k][1]:
            inside = spans[k]
            if s[e : inside[1] - 1].strip():
                continue
            e = inside[1]
        elif c := _CLOSERS.match(s, e):
            e = c.end()
        best = None
        for path in (passed, taken):
            if path is None:
                continue
            start = path[1][0] if path[1] else 0
            if i < start:  # within the closing marks of the one before
                continue
            score = path[0] + _score(s, i, m.group().strip(), e, inside, start, word, before)
            if not _WORD.search(s, start, e):
                score -= WORDLESS
            if best is None or score > best[0]:
                best = (score, (e, path[1]))
        if taken is not None and taken[0] > passed[0]:
            passed = taken
        taken = best
    last = taken if taken is not None and taken[0] > passed[0] else passed
    cuts, node = [], last[1]
    while node:
        cuts.append(node[0])
        node = node[1]
    return cuts[::-1]


def split_prose(s: str, memo: dict) -> list[int]:
    """The ends (exclusive, before white space) of the sentences of a prose block."""
    spans = [m.span() for m in _SPAN.finditer(s)] if any(c in s for c in "„“«「『（(\"[") else []
    cuts = _best_path(s, spans)
    for script, letter in _SPACELESS.items():
        if letter.search(s):
            cuts = sorted([*cuts, *_space_cuts(script, s, cuts, spans, memo)])
    out = [len(s[:c].rstrip()) for c in cuts]
    end = len(s.rstrip())
    return [*dict.fromkeys(x for x in out if 0 < x < end), end]


def is_prose(rows: list[str], foot: bool = False, notices: bool = True) -> bool:
    """Whether a block is running text; greetings and notes count too where they have no inner boundary to lose.

    ``notices`` tells whether a notice below a message (see ``is_notice``) is a block that is not.
    """
    first = rows[0].strip()
    if _RULE.match(first) or first == "--" or _ORIGINAL.match(first):
        return False
    if rows[-1].rstrip()[-1] in ":：" and any("@" in r for r in rows) and _attributes(rows):
        return False
    if len(rows) > 1 and first.rstrip(",.!，。！ ").casefold() in X.SIGN_OFFS:
        return False
    if len(rows) > 1 and (m := _HEADER.match(first)) and m[1] in X.QUOTED_FIELDS and (m2 := _HEADER.match(rows[1].strip())) and m2[1] in X.QUOTED_FIELDS:
        return False
    return not (notices and is_notice(rows, foot))


def _attributes(rows: list[str]) -> bool:
    """Whether a block that names an address and ends with a colon tells who wrote what follows: no sentence of five words stands before its last."""
    s = "\n".join(rows)
    spans = [m.span() for m in _SPAN.finditer(s)]
    cuts = [0, *(c for c in _best_path(s, spans) if s[c:].strip())]
    return all(len(s[a:b].split()) < 5 for a, b in zip(cuts, cuts[1:]))


def is_notice(rows: list[str], foot: bool) -> bool:
    """Whether a block is a notice below a message, by how many of the things such notices speak of it names; at the ``foot`` fewer will do."""
    joined = re.sub(r"\s+", " ", " ".join(rows))
    if len(joined) < 24:
        return False
    folded = " " + _NO_WORD.sub(" ", joined.casefold())
    found = {what: weight for what, weight, stems in _STEMS if any(x in folded for x in stems)}
    if not joined.isascii():
        tight = re.sub(r"(?<=[^\x00-⿿]) (?=[^\x00-⿿])", "", joined)
        found |= {what: weight for what, weight, parts in _STEM_PARTS if any(x in joined or x in tight for x in parts)}
    return sum(found.values()) >= (5 if foot else 6)


def ends_message(rows: list[str]) -> bool:
    """Whether a block is a rule, a signature or a sign-off: below it notices stand."""
    first = rows[0].strip()
    return bool(_RULE.match(first)) or first == "--" or first.rstrip(",.!，。！ ").casefold() in X.SIGN_OFFS


def _blocks(text: str, a: int, b: int) -> Iterator[list[tuple[int, int]]]:
    """Runs of non-blank lines of one quote depth, as (start, end) of what follows the quote marks."""
    block: list[tuple[int, int]] = []
    depth = -1
    for x, y in lines(text, a, b):
        at, d = x, 0
        if x < y and text[x] in ">| \t" and (m := _MARKS.match(text, x, y)):
            at, mark = m.end(), m.group()
            d = mark.count(">") + mark.count("|")
        if not text[at:y].strip():
            if block:
                yield block
            block = []
            continue
        if block and d != depth:
            yield block
            block = []
        depth = d
        block.append((at, y))
    if block:
        yield block


def sentence_ends(text: str | None, memo: dict | None = None, notices: bool = True) -> list[int]:
    """For each sentence unit of a message the number of code points up to and with its last character, ascending.

    With ``notices`` a notice below a message (a disclaimer, say) is one unit; without, its sentences are units like others.
    """
    if not text or not text.strip():
        return []
    memo = {} if memo is None else memo
    out: list[int] = []
    for a, b in plain_parts(text):
        foot = False
        for block in _blocks(text, a, b):
            rows = [text[x:y] for x, y in block]
            s = "\n".join(rows)
            key = ("block", s, foot)  # apart from the words: a block may be one word
            if (ends := memo.get(key)) is None:  # quoted and standing texts come again and again
                ends = memo[key] = split_prose(s, memo) if is_prose(rows, foot, notices) else [len(s.rstrip())]
            foot = ends_message(rows)
            at, marks = 0, []
            for (x, _), r in zip(block, rows):
                marks.append((at, x))
                at += len(r) + 1
            heads = [p for p, _ in marks]
            for e in ends:
                k = bisect_right(heads, e - 1) - 1
                out.append(marks[k][1] + e - marks[k][0])
    return sorted(set(out))


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", notices: bool = True, jars: str | None = None) -> DataFrame:
    """(key, end_char) of every sentence unit of every document.

    One pass over whole texts, without a shuffle; a document is never split over tasks, and results do not depend on batches. A null,
    blank or bodyless text has no units. Repeated rows give repeated results, a null key stays null. Only the two named
    columns are read. ``notices`` is that of ``sentence_ends``. The dictionaries (``jars``: the folder that has them) are read here and sent along.
    """
    sent = documents.sparkSession.sparkContext.broadcast({script: dictionaries.load(script, jars) for script in dictionaries.FILES})  # under 300 kB, fixed

    def units(batches):
        _raw.update(sent.value)
        memo: dict = {}
        for batch in batches:
            at, ends = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if len(memo) > 20_000:  # the cache is emptied; no result depends on it
                    memo.clear()
                e = sentence_ends(t, memo, notices)
                at += [i] * len(e)
                ends += e
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ends, pa.int64())], ["k", "e"])

    rows = spread(documents.select(documents[key].alias("k"), documents[text].alias("t")))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(units, f"k {kind}, e bigint").toDF(key, "end_char")
