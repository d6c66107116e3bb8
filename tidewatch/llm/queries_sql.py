"""SQL twins in DuckDB of the corpus queries that SQL can express."""

from tidewatch.llm import chat, decontaminate, line_templates

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_WORDS = f"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{decontaminate.WORD_RUNS}')"
CONTAMINATION = f"""
    WITH items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
    places AS (
        SELECT item_id, words, least(len(words), {decontaminate.WINDOW}) AS n,
               unnest(range(1, len(words) - least(len(words), {decontaminate.WINDOW}) + 2)) AS i
        FROM items WHERE len(words) > 0),
    windows AS (SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS passage
                FROM places),
    docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
    tried AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
              FROM docs, (SELECT DISTINCT n FROM windows)),
    hits AS (SELECT doc_id, item_id, i, t.n
             FROM (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS passage
                   FROM tried) t
             JOIN windows w ON w.n = t.n AND w.passage = t.passage),
    hit_words AS (SELECT doc_id, count(DISTINCT word_no) AS n_hit
                  FROM (SELECT doc_id, unnest(range(i, i + n)) AS word_no FROM hits) GROUP BY 1),
    hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def _escaped(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


_MARKS = len(chat.OPEN) + len(chat.CLOSE) + 1
_TOKENS = f"(len(regexp_extract_all(text, '{chat.TOKEN}')) + 2)"
CHAT = f"""
    WITH given AS (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
        FROM given),
    sized AS (
        SELECT *, k = 1 AND role = 'system' AS is_system, {_TOKENS} AS t,
               length({_escaped("role")}) + length({_escaped("text")}) + {_MARKS} AS chars
        FROM rows),
    convs AS (SELECT conv_id, max(CASE WHEN is_system THEN t END) AS system_t,
                     max(CASE WHEN is_system THEN chars END) AS system_chars
              FROM sized GROUP BY 1),
    summed AS (
        SELECT s.*, greatest((({chat.BUDGET} - coalesce(system_t, 0)) / 2.0)::DOUBLE, 0) AS room,
               greatest(floor(({chat.BUDGET} - coalesce(system_t, 0)) / 2.0)::BIGINT
                        - {chat.HISTORY}, {max(1, chat.HISTORY)}) AS stride,
               CASE WHEN is_system THEN 0 ELSE t END AS tokens
        FROM sized s JOIN convs USING (conv_id)),
    placed AS (
        SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY k
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM summed),
    windowed AS (SELECT *, before // stride AS w FROM placed),
    windows AS (SELECT DISTINCT conv_id, w FROM windowed),
    again AS (
        SELECT r.conv_id, sum(chars) AS chars
        FROM windowed r JOIN windows n ON n.conv_id = r.conv_id AND n.w = r.w + 1
        WHERE NOT is_system AND before >= (r.w + 1) * stride - {chat.HISTORY}
              AND tokens <= {chat.HISTORY}
        GROUP BY 1),
    heads AS (SELECT conv_id, count(*) - 1 AS n FROM windows GROUP BY 1),
    whole AS (
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), ''))
                   AS loss_sha256,
               sum(chars) AS chars
        FROM windowed GROUP BY 1)
    SELECT conv_id, n_turns, turns_sha256, loss_chars::BIGINT AS loss_chars, loss_sha256,
           (w.chars + coalesce(a.chars, 0) + coalesce(h.n * c.system_chars, 0))::BIGINT
               AS formatted_chars
    FROM whole w JOIN convs c USING (conv_id) JOIN heads h USING (conv_id)
         LEFT JOIN again a USING (conv_id)
"""

_D, _L = line_templates.DEPTH, line_templates.LEAST_WORDS
LINES = rf"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (
        SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no,
               unnest(string_split(text, chr(10))) AS line
        FROM texts),
    parsed AS (
        SELECT doc_id, line_no, list_filter(
                   regexp_split_to_array(
                       regexp_replace(line, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'),
                       '[\x20\x09-\x0D]+'),
                   lambda w: w <> '') AS words
        FROM lines),
    long AS (SELECT *, words[1:{_D}] AS lead, len(words) AS n FROM parsed
             WHERE len(words) >= {_L}
               AND len(list_filter(words, lambda w: w <> '<*>')) >= {line_templates.CONSTANT} * len(words)),
    counted AS (SELECT n, lead, words, count(*) AS times, min(doc_id) AS low, max(doc_id) AS high
                FROM long GROUP BY ALL),
    shared AS (SELECT n, lead FROM counted GROUP BY ALL HAVING count(*) > 1),
    fields AS (SELECT n, lead, words, times, unnest(range(1, n + 1)) AS i, unnest(words) AS word
               FROM counted SEMI JOIN shared USING (n, lead)),
    support AS (SELECT n, lead, i, word, sum(times) AS support FROM fields WHERE i > {_D}
                GROUP BY ALL),
    known AS (SELECT f.n, f.lead, f.words, f.i, f.word, support
              FROM fields f LEFT JOIN support s
              ON s.n = f.n AND s.lead = f.lead AND s.i = f.i AND s.word = f.word),
    ordered AS (SELECT n, lead, words, list(word ORDER BY i) AS ws, list(support ORDER BY i) AS ss,
                       list_sort(list(support) FILTER (WHERE support IS NOT NULL)) AS sorted
                FROM known GROUP BY ALL),
    usual AS (SELECT *, sorted[floor(len(sorted) * {line_templates.VARYING})::INT + 1] AS u
              FROM ordered),
    general AS (SELECT n, lead, words, list_transform(range(1, n + 1), lambda i:
                    CASE WHEN u > 1 AND ss[i] * 2 < u THEN '<*>' ELSE ws[i] END) AS template
                FROM usual),
    named AS (SELECT c.*, coalesce(g.template, c.words) AS template
              FROM counted c LEFT JOIN general g
              ON g.n = c.n AND g.lead = c.lead AND g.words = c.words),
    common AS (SELECT n, lead, template, min(low) AS first FROM named GROUP BY ALL
               HAVING min(low) <> max(high)),
    dropped AS (SELECT a.doc_id, a.line_no
                FROM long a JOIN named b ON b.n = a.n AND b.lead = a.lead AND b.words = a.words
                JOIN common c ON c.n = b.n AND c.lead = b.lead AND c.template = b.template
                WHERE a.doc_id <> c.first),
    rest AS (SELECT l.doc_id, count(*) AS n_lines, count(d.line_no) AS n_dropped,
                    coalesce(string_agg(line, chr(10) ORDER BY l.line_no)
                             FILTER (WHERE d.line_no IS NULL), '') AS text
             FROM lines l LEFT JOIN dropped d ON d.doc_id = l.doc_id AND d.line_no = l.line_no
             GROUP BY 1)
    SELECT doc_id, n_lines, n_dropped, sha256(text) AS text_sha256 FROM rest
"""


_CRC_STEPS = (
    "list_reduce(list_concat([xor(crc, byte)], range(8)), lambda c, k: "
    "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
)


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return (
        f"xor(list_reduce(list_concat([4294967295], {codes}), lambda crc, byte: {_CRC_STEPS}), 4294967295)"
    )


def _field(name: str, value: str | None = None) -> str:
    value = value or f"{name}::VARCHAR"
    return f"coalesce(strlen({value})::VARCHAR || ':' || ({value}), '-')"


def _leaf(n_chars: str) -> str:
    fields = [_field("doc_id"), _field("source"), _field("lang"),
              _field("n_chars", f"({n_chars})::VARCHAR"), _field("text")]
    return f"sha256({' || '.join(fields)})"


def _levels(name: str, start: str, keys: str) -> str:
    """All nodes of the trees over ``start`` (keys, n, level, i, h)."""
    return f"""
    {name} AS (
        SELECT * FROM {start}
        UNION ALL
        SELECT {keys}, (n + 1) // 2, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i))
        FROM {name} WHERE n > 1 GROUP BY {keys}, n, level, i // 2)"""


MERKLE = f"""
    WITH RECURSIVE docs AS (
        SELECT lang, doc_id, {_leaf("n_chars")} AS leaf,
               {_leaf(f"n_chars + ({crc32_sql('doc_id::VARCHAR')} % 7 = 0)::INT")} AS changed
        FROM documents),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
               count(*) OVER (PARTITION BY lang) AS n
        FROM docs),
    start AS (SELECT lang, n, 0::BIGINT AS level, i, leaf AS h FROM leaves),
    {_levels("nodes", "start", "lang")},
    subroots AS (
        SELECT lang, h AS subroot, level AS depth,
               row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS lang_i
        FROM nodes WHERE n = 1),
    tops AS (SELECT (SELECT count(*) FROM subroots) AS n, 0::BIGINT AS level, lang_i AS i,
                    subroot AS h, 0 AS whole FROM subroots),
    tops_start AS (SELECT whole, n, level, i, h FROM tops),
    {_levels("uppers", "tops_start", "whole")},
    ways AS (
        SELECT doc_id, leaf, v.lang, coalesce(changed, leaf) AS folded,
               '' AS proof, 0::BIGINT AS level, i, n, false AS upper, subroot, lang_i
        FROM leaves v JOIN subroots s ON s.lang IS NOT DISTINCT FROM v.lang
        UNION ALL
        SELECT * FROM (
            WITH steps AS (
                SELECT w.*, s.h AS sibling FROM ways w LEFT JOIN (
                    SELECT lang, false AS upper, level, i, h FROM nodes
                    UNION ALL SELECT lang, true, u.level, u.i, u.h
                    FROM uppers u, (SELECT DISTINCT lang FROM subroots)) s
                ON s.lang IS NOT DISTINCT FROM w.lang AND s.upper = w.upper
                   AND s.level = w.level AND s.i = xor(w.i, 1)
                WHERE w.n > 1)
            SELECT doc_id, leaf, lang, sha256(CASE WHEN i % 2 = 1 THEN sibling || folded
                               ELSE folded || coalesce(sibling, '') END),
                   proof || coalesce(sibling, ''), level + 1, i // 2, (n + 1) // 2, upper,
                   subroot, lang_i
            FROM steps
            UNION ALL
            SELECT doc_id, leaf, lang, folded, proof, 0, lang_i,
                   (SELECT count(*) FROM subroots), true, subroot, lang_i
            FROM ways WHERE n = 1 AND NOT upper))
    SELECT doc_id, leaf, subroot, (SELECT h FROM uppers WHERE n = 1) AS root,
           sha256(proof) AS proof_sha256, folded AS folded_root,
           folded = (SELECT h FROM uppers WHERE n = 1) AS verified
    FROM ways WHERE n = 1 AND upper
"""


_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_INKED = r"[^\x20\x09-\x0D]"
REPAIR = f"""
    WITH RECURSIVE given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc32_sql(_KEY)} % 20 AS kind, row_number() OVER () AS r
        FROM conversations),
    damaged AS (
        SELECT conv_id, turn, r, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                         ELSE text END AS text,
               unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM given),
    lined AS (
        SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '{_INKED}') AS is_blank,
               row_number() OVER (PARTITION BY conv_id
                   ORDER BY turn NULLS FIRST, role, sha256(text), r, copy) - 1 AS i,
               count(*) OVER (PARTITION BY conv_id) AS n
        FROM damaged),
    marked AS (
        SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
               CASE WHEN is_blank THEN 'b'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text, is_blank
                                            ORDER BY i) > 1 THEN 'd'
                    WHEN regexp_extract(text, '({_INKED})[\\x20\\x09-\\x0D]*$', 1)
                         NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
        FROM lined),
    counts AS (
        SELECT conv_id, any_value(n) AS n,
               coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (WHERE fault = 'b') AS blank,
               count(*) FILTER (WHERE fault = 'd') AS duplicate,
               count(*) FILTER (WHERE fault = 't') AS truncated,
               count(*) FILTER (WHERE i > 0 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM marked GROUP BY conv_id),
    inserts(q, via, letters, added) AS (VALUES
        (0, 0, '', []::VARCHAR[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []),
        (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']),
        (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
        (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:'])),
    edits(via, letter, initial, price, state) AS (VALUES
        (0, 'D', NULL, 2, 0), (1, 'D', NULL, 2, 1), (2, 'D', NULL, 2, 2), (3, 'D', NULL, 2, 3),
        (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3),
        (3, 'K', 'u', 0, 2), (0, 'R', NULL, 1, 2), (1, 'R', NULL, 1, 2), (2, 'R', NULL, 1, 3),
        (3, 'R', NULL, 1, 2)),
    ways AS (
        SELECT conv_id, 0::BIGINT AS i, 0 AS q,
               {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best
        FROM counts
        UNION ALL
        SELECT w.conv_id, w.i + 1, e.state, min({{
            'cost': w.best.cost + 5 * length(letters) + price
                    + CASE WHEN letter <> 'D' AND fault = 't' THEN 5 ELSE 0 END,
            'audit': w.best.audit || letters || letter,
            'lines': list_concat(w.best.lines, added, CASE letter WHEN 'D' THEN []
                WHEN 'K' THEN [role || ':' || text]
                ELSE [CASE e.state WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END)}})
        FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i
        JOIN inserts USING (q)
        JOIN edits e ON e.via = inserts.via AND (e.letter = 'D' OR fault NOT IN ('b', 'd'))
            AND (e.initial IS NULL OR e.initial = m.initial)
        GROUP BY w.conv_id, w.i, e.state),
    done AS (
        SELECT w.conv_id, min({{'cost': best.cost + 5 * length(letters),
                              'audit': best.audit || letters,
                              'lines': list_concat(best.lines, added)}}) AS best
        FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
        JOIN inserts USING (q) WHERE via IN (0, 3) GROUP BY w.conv_id)
    SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
           coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
           coalesce(best.audit, '') AS audit,
           sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
    LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM a.conv_id
"""
