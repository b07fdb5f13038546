"""Character classes as regular-expression class bodies (Java and RE2 read them alike), and fixed values.

All lengths and offsets of this library are in code points.
"""

#: White space in the wide sense, no-break and ideographic spaces and the byte order mark included.
WS = r"\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
LATIN = r"A-Za-z\x{00C0}-\x{024F}"
#: Han, kana, Hangul and compatibility ideographs.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
#: The wider class that decides whether two lines join without a space.
CJK_WIDE = r"\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"

#: Latin letters and digits one by one: Java looks single characters up in a table, but asks every range of a class in turn.
PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def all_but(marks: str) -> str:
    """The usual characters of Latin scripts but for `marks`, one by one, as a class body."""
    return PLAIN + "".join("\\" + ch for ch in " !\"#$%&'()*+,-./:;<=>?@[]^_`{|}~" if ch not in marks)


# These follow the documents and tools that the library must agree with.
CJK_END = "。！？…‥．"
CJK_CLOSE = "」』）】〉》”’"
CJK_PUNCT = r"\x{3000}-\x{303F}\x{FF00}-\x{FF65}" + CJK_CLOSE + CJK_END
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "inc", "ltd", "co", "dept", "univ", "vol", "fig", "no", "approx", "ch")
CLAUSE_MARKS = "，、；：,;:"
HARD_MARKS = "，,、；;：: "
MAX_SENTENCE, SHORTEST_CUT, MIN_SENTENCE, MIN_CLAUSE = 180, 73, 2, 2
MIN_FOREIGN_EN, MIN_FOREIGN_ZH = 12, 1
MAX_HEADING, MAX_TITLE, MIN_BODY, MAX_UNIT = 40, 40, 40, 16_000
EMPTY_FILE, WHOLE_TEXT, FRONT, CONTINUED = "（空白檔案）", "全文", "開頭", "（續 {}）"
EMPTY_PAGES = "（這個 PDF 沒有可讀的文字）"
NUMERALS = "0-9０-９零一二三四五六七八九十百千萬万两兩"
UNITS = "章回節节卷篇部集話话"
MATTER = ("序", "自序", "序言", "前言", "引言", "楔子", "序章", "後記", "后记", "跋", "附錄", "附录", "結語", "结语", "目錄", "目录", "導讀", "导读", "終章", "终章", "尾聲", "尾声")
#: Radicals of the supplement block that stand for whole characters.
RADICALS = {
    "⺜": "日", "⺝": "月", "⺠": "民", "⺩": "王", "⺫": "目", "⺮": "竹", "⺼": "肉", "⻄": "西", "⻅": "见", "⻆": "角", "⻊": "足",
    "⻑": "長", "⻒": "長", "⻓": "长", "⻔": "门", "⻗": "雨", "⻘": "青", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻡": "首",
    "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻩": "黄", "⻪": "黾", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻱": "龜",
}
CLAUSE_PAUSE_MS, SENTENCE_PAUSE_MS, BLOCK_PAUSE_MS = 150, 150, 250
