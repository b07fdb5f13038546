"""SQL for the text rules of the library, as pieces from which the queries' SQL is put together.

The rules with look-behind are written over one row per character, greedy ones as
reductions of lists or recursions; nothing here is shared with the DataFrame operators
but the character classes and fixed values.
"""

from __future__ import annotations

from folio.functions import chars as C

TRIM = f"regexp_replace(regexp_replace(%s, '^[{C.WS}]+', ''), '[{C.WS}]+$', '')"
_CLOSE = C.CJK_CLOSE + "\"')]"


def quoted(text: str) -> str:
    return text.replace("'", "''")


def one_of(chars: str) -> str:
    return ", ".join(f"'{quoted(c)}'" for c in chars)


def solid(x: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '[{C.CJK}{C.LATIN}0-9]', '', 'g')))"


def spoken(x: str) -> str:
    """What a voice says of a text: signs inside words and numbers are put aside, the others become spaces."""
    out = f"regexp_replace({x}, '[^{C.WS}{C.LATIN}0-9{C.CJK}$%&@''’.:,-]', ' ', 'g')"
    inside = [(k, sign, cls) for k, (sign, cls) in enumerate([("''", C.LATIN), ("’", C.LATIN), ("-", C.LATIN), ("\\.", "0-9"), (":", "0-9"), (",", "0-9")])]
    for k, sign, cls in inside:
        for _ in range(2):  # neighbours share a letter
            out = f"regexp_replace({out}, '([{cls}]){sign}([{cls}])', '\\1' || chr({57344 + k}) || '\\2', 'g')"
    out = f"regexp_replace({out}, '[''’.:,-]', ' ', 'g')"
    aside = " || ".join(f"chr({57344 + k})" for k, _, _ in inside)
    return TRIM % f"regexp_replace(translate({out}, {aside}, '''’-.:,'), '[{C.WS}]+', ' ', 'g')"


#: CTE sents(doc_id, b, i, t, o) over blocks(doc_id, b, k, t).
SENTENCES = rf"""
    sch AS (SELECT doc_id, b, t, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM blocks),
    scn AS (SELECT *, lead(c) OVER (PARTITION BY doc_id, b ORDER BY i) AS nx FROM sch),
    sfo AS (SELECT *, nx IS NULL OR regexp_matches(nx, '[{C.WS}"''”’)\]{C.CJK}{C.CJK_PUNCT}]') AS fo FROM scn WHERE c IN ({one_of(C.CJK_END + ".!?" + _CLOSE)})),
    sqt AS (SELECT doc_id, b, i, CASE WHEN c IN ({one_of(C.CJK_END)}) THEN true WHEN c IN ('!', '?') THEN fo
            WHEN c = '.' THEN fo AND NOT regexp_matches(substr(t, greatest(1, i - 8), i - greatest(1, i - 8)), '(?i)(^|[^a-z])([a-z]|{"|".join(C.ABBREVIATIONS)})$') ELSE false END AS q FROM sfo),
    sgr AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, b ORDER BY i) AS g FROM sqt),
    sen AS (SELECT doc_id, b, max(i) AS e FROM sgr GROUP BY doc_id, b, g HAVING bool_or(q) UNION SELECT doc_id, b, length(t) FROM blocks),
    scu AS (SELECT s.doc_id, s.b, coalesce(lag(e) OVER (PARTITION BY s.doc_id, s.b ORDER BY e), 0) AS o, e, t FROM sen s JOIN blocks USING (doc_id, b)),
    spc AS (SELECT doc_id, b, o, substr(t, o + 1, e - o) AS t FROM scu WHERE regexp_matches(substr(t, o + 1, e - o), '[^{C.WS}]')),
    shr(doc_id, b, o, t, rest, ro) AS (
        SELECT doc_id, b, o, NULL::VARCHAR, t, o FROM spc WHERE length(t) > {C.MAX_SENTENCE}
        UNION ALL SELECT doc_id, b, ro, left(rest, n), substr(rest, n + 1), ro + n FROM (
            SELECT doc_id, b, ro, rest, CASE WHEN length(rest) <= {C.MAX_SENTENCE} THEN length(rest) WHEN m = '' THEN {C.MAX_SENTENCE} ELSE length(m) END AS n FROM (
                SELECT *, regexp_extract(rest, '^(?s:.{{{C.SHORTEST_CUT},{C.MAX_SENTENCE}}})[{C.HARD_MARKS}]') AS m FROM shr WHERE rest <> ''))),
    sal AS (SELECT doc_id, b, o, t FROM spc WHERE length(t) <= {C.MAX_SENTENCE} UNION ALL SELECT doc_id, b, o, t FROM shr WHERE t IS NOT NULL AND (rest <> '' OR regexp_matches(t, '[^{C.WS}]'))),
    sli AS (SELECT doc_id, b, list({{'t': t, 'o': o}} ORDER BY o) AS ps FROM sal GROUP BY doc_id, b),
    sme AS (SELECT doc_id, b, list_reduce(list_transform(ps, lambda p: [p]), lambda a, x: CASE WHEN length({TRIM % "a[-1].t"}) < {C.MIN_SENTENCE} THEN a[:-2] || [{{'t': a[-1].t || x[1].t, 'o': a[-1].o}}] ELSE a || x END) AS ps FROM sli),
    swh AS (SELECT doc_id, b, coalesce(ps, [{{'t': t, 'o': 0}}]) AS ps FROM blocks LEFT JOIN sme USING (doc_id, b)),
    sun AS (SELECT doc_id, b, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS p FROM swh),
    sents AS (SELECT doc_id, b, CAST(i AS BIGINT) AS i, p.t AS t, CAST(p.o AS BIGINT) AS o FROM sun)"""


def clause_ctes(source: str, keys: str, name: str) -> str:
    """CTE `name`(keys, c, t, o) of the clauses of `source`(keys, t)."""
    return rf"""
    {name}_p AS (SELECT {keys}, t AS w, list_filter(regexp_extract_all(t, '(?s)[^{C.CLAUSE_MARKS}]*(?:[{C.CLAUSE_MARKS}][{C.WS}]*|$)'), lambda p: p <> '') AS ps FROM {source}),
    {name}_s AS (SELECT {keys}, {solid("w")} AS s, list_transform(ps, lambda p: [{{'t': p, 'n': {solid("p")}, 'm': {solid("p")}}}]) AS ps FROM {name}_p WHERE len(ps) > 0),
    {name}_r AS (SELECT {keys}, list_reduce(ps, lambda a, x: CASE WHEN (regexp_matches(a[-1].t, '[0-9][,:]$') AND regexp_matches(x[1].t, '^[0-9]')) OR a[-1].n < {C.MIN_CLAUSE} OR s - a[-1].m < {C.MIN_CLAUSE}
                THEN a[:-2] || [{{'t': a[-1].t || x[1].t, 'n': a[-1].n + x[1].n, 'm': a[-1].m + x[1].n}}] ELSE a || [{{'t': x[1].t, 'n': x[1].n, 'm': a[-1].m + x[1].n}}] END) AS cs FROM {name}_s),
    {name}_u AS (SELECT {keys}, generate_subscripts(cs, 1) - 1 AS c, unnest(cs).t AS t FROM {name}_r),
    {name} AS (SELECT {keys}, CAST(c AS BIGINT) AS c, t, CAST(coalesce(sum(length(t)) OVER (PARTITION BY {keys} ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM {name}_u)"""


def run_ctes(source: str, keys: str, name: str) -> str:
    """CTE `name`(keys, r, t, lang, o) of the script runs of `source`(keys, t)."""
    z, e = r"\x{E000}", r"\x{E001}"
    sides = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[{z}{e}]', '0', 'g'), '[{C.CJK}{C.CJK_PUNCT}]', chr(57344), 'g'), '[{C.LATIN}]', chr(57345), 'g'), '[^{z}{e}]', '0', 'g')"
    count = lambda cls: f"(length(t) - length(regexp_replace(t, '[{cls}]', '', 'g')))"
    many = lambda k: f"length(regexp_replace(w, '[^\\x{{{k}}}]', '', 'g'))"
    return rf"""
    {name}_h AS (SELECT {keys}, t, {count(C.CJK)} AS han, {count(C.LATIN)} AS latin, {sides} AS sides FROM {source} WHERE t <> ''),
    {name}_t AS (SELECT {keys}, t, 4 * han >= latin AS zh, CASE WHEN 4 * han >= latin THEN regexp_extract_all(sides, '{e}[{e}0]*|[^{e}]+') ELSE regexp_extract_all(sides, '{z}[{z}0]*|[^{z}]+') END AS ws FROM {name}_h WHERE han > 0 AND latin > 0),
    {name}_w AS (SELECT {keys}, t, zh, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM {name}_t),
    {name}_f AS (SELECT *, CASE WHEN zh THEN starts_with(w, chr(57345)) AND {many("E001")} >= {C.MIN_FOREIGN_EN} ELSE starts_with(w, chr(57344)) AND {many("E000")} >= {C.MIN_FOREIGN_ZH} END AS f FROM {name}_w),
    {name}_c AS (SELECT {keys}, t, zh, n, unnest([0, 1]) AS half, unnest([CASE WHEN f THEN length(rtrim(w, '0')) ELSE 0 END, CASE WHEN f THEN length(w) - length(rtrim(w, '0')) ELSE length(w) END]) AS len FROM {name}_f),
    {name}_o AS (SELECT *, sum(len) OVER v - len AS o, count_if(half <> lag_half) OVER v AS g FROM (SELECT *, lag(half) OVER (PARTITION BY {keys} ORDER BY n, half) AS lag_half FROM {name}_c WHERE len > 0) WINDOW v AS (PARTITION BY {keys} ORDER BY n, half ROWS UNBOUNDED PRECEDING)),
    {name}_g AS (SELECT {keys}, g, any_value(t) AS t, any_value(zh) AS zh, any_value(half) AS half, min(o) AS o, sum(len) AS len FROM {name}_o GROUP BY {keys}, g),
    {name}_m AS (SELECT {keys}, substr(t, CAST(o AS BIGINT) + 1, CAST(len AS BIGINT)) AS t, CASE WHEN zh = (half = 1) THEN 'zh' ELSE 'en' END AS lang, o FROM {name}_g),
    {name}_a AS (SELECT * FROM {name}_m WHERE regexp_matches(t, '[^{C.WS}]')
        UNION ALL SELECT {keys}, t, CASE WHEN latin > 0 THEN 'en' ELSE 'zh' END, 0 FROM {name}_h WHERE han = 0 OR latin = 0),
    {name} AS (SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY o) - 1 AS BIGINT) AS r, t, lang, CAST(o AS BIGINT) AS o FROM {name}_a)"""


def queue_sql(blocks: str) -> str:
    """SQL of the speech queue: what is said and the pauses between, numbered by document."""
    return rf"""WITH RECURSIVE {blocks}, {SENTENCES}, {run_ctes("sents", "doc_id, b, i", "qr")},
        {clause_ctes("qr", "doc_id, b, i, r, lang", "qc")},
        said AS (SELECT doc_id, b, i, r, c, lang, {spoken("t")} AS say, regexp_matches(t, '[{C.CLAUSE_MARKS}][{C.WS}{quoted(C.CJK_CLOSE)}"'')\]]*$') AS brk FROM qc),
        part AS (SELECT *, lead(r) OVER (PARTITION BY doc_id, b, i ORDER BY r, c) IS NULL AS final FROM said WHERE say <> ''),
        first AS (SELECT doc_id, b, min(i) AS i FROM part GROUP BY doc_id, b),
        item AS (
            SELECT p.doc_id, p.b, p.i, r, c, 0 AS k, s.o AS o, say, lang, NULL::BIGINT AS pause_ms FROM part p JOIN sents s USING (doc_id, b, i)
            UNION ALL SELECT doc_id, b, i, r, c, 1, NULL, NULL, NULL, {C.CLAUSE_PAUSE_MS} FROM part WHERE brk AND NOT final
            UNION ALL SELECT s.doc_id, s.b, s.i, -1, 0, 0, NULL, NULL, NULL, {C.SENTENCE_PAUSE_MS} FROM sents s JOIN first f ON f.doc_id = s.doc_id AND f.b = s.b AND s.i > f.i
            UNION ALL SELECT doc_id, b, 1000000000, 0, 0, 0, NULL, NULL, NULL, {C.BLOCK_PAUSE_MS} FROM blocks)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, i, r, c, k) - 1 AS seq, b, o, say, lang, pause_ms FROM item"""


def unit_ctes(blocks: str, key: str) -> str:
    """CTE units(key, ci, title, start, end, body, chars) over `blocks`(key, b, k, t)."""
    title = lambda x: f"left({TRIM % f'string_split({x}, chr(10))[1]'}, {C.MAX_TITLE})"
    one, two = C.CONTINUED.split("{}")
    return rf"""
    ub AS (SELECT {key}, b, k, t, length(t) AS n, CASE WHEN k = 'h' THEN 0 ELSE length(t) END AS m, count_if(k = 'h') OVER (PARTITION BY {key} ORDER BY b) AS part FROM {blocks}),
    uc AS (SELECT {key}, part, min(b) AS s, max(b) + 1 AS e, arg_min(t, b) AS f, sum(m)::BIGINT AS body, sum(n)::BIGINT AS chars, count(*) OVER (PARTITION BY {key}) AS parts FROM ub GROUP BY {key}, part),
    ut AS (SELECT {key}, s, e, body, chars, CASE WHEN part > 0 THEN {title("f")} WHEN parts = 1 THEN '{C.WHOLE_TEXT}' ELSE '{C.FRONT}' END AS title FROM uc),
    ul AS (SELECT {key}, list({{'s': s, 'e': e, 'title': title, 'body': body, 'chars': chars}} ORDER BY s) AS cs FROM ut GROUP BY {key}),
    um AS (SELECT {key}, list_reduce(list_transform(cs, lambda c: [c]), lambda a, x: CASE WHEN a[-1].body < {C.MIN_BODY}
           THEN a[:-2] || [{{'s': a[-1].s, 'e': x[1].e, 'title': CASE WHEN x[1].title = '' THEN a[-1].title ELSE x[1].title END, 'body': a[-1].body + x[1].body, 'chars': a[-1].chars + x[1].chars}}] ELSE a || x END) AS cs FROM ul),
    uf AS (SELECT {key}, CASE WHEN len(cs) > 1 AND cs[-1].body < {C.MIN_BODY}
           THEN cs[:-3] || [{{'s': cs[-2].s, 'e': cs[-1].e, 'title': cs[-2].title, 'body': cs[-2].body + cs[-1].body, 'chars': cs[-2].chars + cs[-1].chars}}] ELSE cs END AS cs FROM um),
    ux AS (SELECT {key}, unnest(cs) AS c FROM uf),
    ug AS (SELECT {key}, c.s AS s, c.e AS e, c.title AS title, c.body AS body, c.chars AS chars FROM ux WHERE c.e > c.s),
    uo AS (SELECT ug.{key}, s, title, list({{'b': ub.b, 'n': ub.n, 'm': ub.m, 'acc': ub.n, 'p': 0}} ORDER BY ub.b) AS bs FROM ug JOIN ub ON ub.{key} = ug.{key} AND ub.b >= s AND ub.b < e WHERE chars > {C.MAX_UNIT} GROUP BY ug.{key}, s, title),
    uq AS (SELECT {key}, s, title, unnest(list_reduce(list_transform(bs, lambda x: [x]), lambda a, x: a || [{{'b': x[1].b, 'n': x[1].n, 'm': x[1].m, 'acc': CASE WHEN a[-1].acc >= {C.MAX_UNIT} THEN x[1].n ELSE a[-1].acc + x[1].n END, 'p': a[-1].p + CASE WHEN a[-1].acc >= {C.MAX_UNIT} THEN 1 ELSE 0 END}}])) AS x FROM uo),
    uz AS (SELECT {key}, title || CASE WHEN x.p = 0 THEN '' ELSE '{one}' || (x.p + 1) || '{two}' END AS title, min(x.b) AS s, max(x.b) + 1 AS e, sum(x.m) AS body, sum(x.n) AS chars FROM uq GROUP BY {key}, s, title, x.p),
    ua AS (SELECT {key}, title, s, e, body, chars FROM ug WHERE chars <= {C.MAX_UNIT} UNION ALL SELECT {key}, title, s, e, body, chars FROM uz),
    units AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY s) - 1 AS BIGINT) AS ci, title, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(body AS BIGINT) AS body, CAST(chars AS BIGINT) AS chars FROM ua)"""


#: CTE saves(user_id, at, pos, timer) over events, the throttling as one reduction a user.
SAVES = r"""
    te AS (SELECT user_id, list({'t': epoch_us(ts) // 1000, 'p': value, 'saved': NULL::BIGINT, 'due': NULL::BIGINT, 'held': NULL::DOUBLE, 'out': []::STRUCT("at" BIGINT, pos DOUBLE, timer BOOLEAN)[]} ORDER BY ts, event_id) AS es FROM events GROUP BY user_id),
    t0 AS (SELECT user_id, list_prepend({'t': NULL::BIGINT, 'p': NULL::DOUBLE, 'saved': NULL::BIGINT, 'due': NULL::BIGINT, 'held': NULL::DOUBLE, 'out': []::STRUCT("at" BIGINT, pos DOUBLE, timer BOOLEAN)[]}, es) AS es FROM te),
    tf AS (SELECT user_id, list_reduce(es, lambda s, e: {
        't': e.t, 'p': e.p,
        'saved': CASE WHEN coalesce(s.due <= e.t, false) THEN CASE WHEN e.t - s.due > 8000 THEN e.t ELSE s.due END WHEN s.saved IS NULL OR e.t - s.saved > 8000 THEN e.t ELSE s.saved END,
        'due': CASE WHEN coalesce(s.due <= e.t, false) THEN CASE WHEN e.t - s.due > 8000 THEN NULL WHEN e.t - s.due < 2500 THEN e.t + 2500 ELSE e.t + 700 END
                    WHEN s.saved IS NULL OR e.t - s.saved > 8000 THEN NULL WHEN e.t - s.saved < 2500 THEN e.t + 2500 ELSE e.t + 700 END,
        'held': e.p,
        'out': CASE WHEN coalesce(s.due <= e.t, false) THEN s.out || [{'at': s.due, 'pos': s.held, 'timer': true}] ELSE s.out END
            || CASE WHEN coalesce(s.due <= e.t, false) THEN CASE WHEN e.t - s.due > 8000 THEN [{'at': e.t, 'pos': e.p, 'timer': false}] ELSE [] END
                    WHEN s.saved IS NULL OR e.t - s.saved > 8000 THEN [{'at': e.t, 'pos': e.p, 'timer': false}] ELSE [] END}) AS s FROM t0),
    tl AS (SELECT user_id, unnest(CASE WHEN s.due IS NULL THEN s.out ELSE s.out || [{'at': s.due, 'pos': s.held, 'timer': true}] END) AS x FROM tf),
    saves AS (SELECT user_id, x."at" AS "at", x.pos AS pos, x.timer AS timer FROM tl)"""

#: CTE nav(page_id, ti, href, label, lv) and pb(page_id, b, k, t) over pages: their lists of links are flat, and
#: all text lies in elements without block elements in them.
PAGES = rf"""
    body AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)$', 1), '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS h FROM pages),
    marked AS (SELECT page_id, regexp_replace(regexp_replace(h, '<br */?>', chr(10), 'g'), '</?(p|div|li|article|nav|h1|footer|ul|body)( [^>]*)?>', chr(1) || '\1' || chr(2), 'g') AS h FROM body),
    piece AS (SELECT page_id, unnest(string_split(h, chr(1))) AS x, generate_subscripts(string_split(h, chr(1)), 1) AS n FROM marked),
    plain AS (SELECT page_id, n, CASE WHEN starts_with(x, 'h1' || chr(2)) THEN 'h' ELSE 'p' END AS k,
              replace(replace(replace(replace(regexp_replace(regexp_replace(x, '^[a-z0-9]+' || chr(2), ''), '<[^>]*>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') AS t FROM piece),
    tidy AS (SELECT page_id, n, k, {TRIM % r"regexp_replace(regexp_replace(replace(t, chr(160), ' '), '[ \t\r]+', ' ', 'g'), ' *\n+ *', chr(10), 'g')"} AS t FROM plain),
    pb AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS BIGINT) AS b, k, t FROM tidy WHERE t <> ''),
    link AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a href="([^"]*)">(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a href="([^"]*)">(.*?)</a>', 2)) AS label,
             generate_subscripts(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">'), 1) - 1 AS ti FROM pages),
    nav AS (SELECT page_id, CAST(ti AS BIGINT) AS ti, replace(replace(href, '&quot;', '"'), '&amp;', '&') AS href, {TRIM % "replace(replace(label, '&quot;', chr(34)), '&amp;', '&')"} AS label, 0 AS lv FROM link)"""
