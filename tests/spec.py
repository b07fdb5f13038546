"""Plain Python specifications of the library's text rules, for comparison on small inputs."""

import re
from itertools import groupby

from folio.functions import chars as C


def _range(body):
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: "\\u" + m[1].zfill(4), body)


HAN = re.compile(f"[{_range(C.CJK)}]")
LATIN = re.compile(f"[{_range(C.LATIN)}]")
PUNCT = set(C.CJK_CLOSE + C.CJK_END) | {chr(c) for c in (*range(0x3000, 0x3040), *range(0xFF00, 0xFF66))}
WS = C.WS_CHARS


def is_end(text, i):
    """Whether the mark at i ends a sentence."""
    c = text[i]
    if c in C.CJK_END:
        return True
    if c not in ".!?":
        return False
    before, after = text[:i], text[i + 1 : i + 2]
    if c == ".":
        word = re.search(r"[A-Za-z]*\Z", before)[0]
        if len(word) == 1 or word.lower() in C.ABBREVIATIONS:
            return False
    return not after or after in WS or after in "\"'”’)]" or bool(HAN.match(after)) or after in PUNCT


def sentences(text):
    pieces, start, i = [], 0, 0
    while i < len(text):
        if is_end(text, i):
            while i + 1 < len(text) and text[i + 1] in C.CJK_END + C.CJK_CLOSE + ".!?\"')]":
                i += 1
            pieces.append((start, text[start : i + 1]))
            start = i + 1
        i += 1
    pieces.append((start, text[start:]))
    pieces = [(o, t) for o, t in pieces if t.strip(WS)]
    cut = []
    for o, t in pieces:
        many = len(t) > 180
        while len(t) > 180:
            at = next((j + 1 for j in range(180, 72, -1) if j < len(t) and t[j] in C.HARD_MARKS), 180)
            cut.append((o, t[:at]))
            o, t = o + at, t[at:]
        if not many or t.strip(WS):
            cut.append((o, t))
    out, held = [], None
    for k, (o, t) in enumerate(cut):
        if held is not None:
            o, t = held[0], held[1] + t
        held = None
        if len(t.strip(WS)) < 2 and k + 1 < len(cut):
            held = (o, t)
        else:
            out.append((o, t))
    return out


def solid(t):
    return sum(bool(HAN.match(c) or LATIN.match(c) or c in "0123456789") for c in t)


def clauses(text):
    out, start = [], 0
    for m in re.finditer(f"[{C.CLAUSE_MARKS}][{re.escape(WS)}]*", text):
        number = m[0][0] in ",:" and re.match("[0-9].[0-9]", text[max(0, m.start() - 1) : m.start() + 2])
        if not number and min(solid(text[start : m.start()]), solid(text[m.end() :])) >= 2:
            out.append((start, text[start : m.end()]))
            start = m.end()
    return out + [(start, text[start:])] * (start < len(text))


def said(text):
    out = ""
    for i, c in enumerate(text):
        p, n = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        letters, digits = bool(LATIN.match(p) and LATIN.match(n)), p in tuple("0123456789") and n in tuple("0123456789")
        keep = c in "$%&@" or c in WS or c in "0123456789" or HAN.match(c) or LATIN.match(c) or (c in "'’-" and letters) or (c in ".:," and digits)
        out += c if keep else " "
    return re.sub(f"[{re.escape(WS)}]+", " ", out).strip(WS)


def side(c):
    return "zh" if HAN.match(c) or c in PUNCT else "en" if LATIN.match(c) else ""


def runs(text, need_en=12, need_zh=1):
    """Positions of the other script, filled up between the first and last of each stretch, then grouped."""
    han, latin = len(HAN.findall(text)), len(LATIN.findall(text))
    if not han or not latin:
        return [(text, "en" if latin else "zh", 0)] if text else []
    own, other, need = ("zh", "en", need_en) if 4 * han >= latin else ("en", "zh", need_zh)
    sides, foreign = [side(c) for c in text], set()
    for is_own, stretch in groupby(range(len(text)), lambda i: sides[i] == own):
        at = [i for i in stretch if sides[i]]
        if not is_own and len(at) >= need:
            foreign.update(range(at[0], at[-1] + 1))
    groups = [(flag, list(g)) for flag, g in groupby(range(len(text)), foreign.__contains__)]
    found = [(text[g[0] : g[-1] + 1], other if flag else own, g[0]) for flag, g in groups]
    return [r for r in found if r[0].strip(WS)] or [(text, own, 0)]


def units(blocks):
    """[(title, start, end)] for [(kind, text)]."""
    heads = [i for i, (k, _) in enumerate(blocks) if k == "h"]
    title = lambda t: t.split("\n")[0].strip(WS)[:40]
    chapters = [[blocks[i][1], i, j] for i, j in zip(heads, [*heads[1:], len(blocks)])]
    if not chapters:
        chapters = [[C.WHOLE_TEXT, 0, len(blocks)]]
    elif chapters[0][1] > 0:
        chapters.insert(0, [C.FRONT, 0, chapters[0][1]])
    body = lambda c: sum(len(t) for k, t in blocks[c[1] : c[2]] if k != "h")
    merged = []
    for t, a, b in chapters:
        if merged and body(merged[-1]) < 40:
            merged[-1] = [title(t) or merged[-1][0], merged[-1][1], b]
        else:
            merged.append([title(t), a, b])
    if len(merged) > 1 and body(merged[-1]) < 40:
        last = merged.pop()
        merged[-1][2] = last[2]
    out = []
    for t, a, b in merged:
        if sum(len(x) for _, x in blocks[a:b]) <= 16_000:
            out.append((t, a, b))
            continue
        start, acc, part = a, 0, 1
        for i in range(a, b):
            acc += len(blocks[i][1])
            if acc >= 16_000 or i == b - 1:
                out.append((t if part == 1 else f"{t}（續 {part}）", start, i + 1))
                start, acc, part = i + 1, 0, part + 1
    return out


def saves(events):
    """[(at, pos, timer)] for [(t, pos)] in order."""
    out, last, due, held = [], None, None, None
    for t, p in events:
        if due is not None and due <= t:
            out.append((due, held, True))
            last, due = due, None
        if last is None or t - last > 8000:
            out.append((t, p, False))
            last, due = t, None
        else:
            due, held = t + (2500 if t - last < 2500 else 700), p
    if due is not None:
        out.append((due, held, True))
    return out
