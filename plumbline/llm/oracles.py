"""DuckDB SQL of the queries that SQL can express, written from their definitions."""

ORACLES: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')"

ORACLES["op2_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 7)) AS times FROM p),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS at FROM n WHERE times > 1),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
      WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
      len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutters
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
  + (CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN 10 * n_stutters > 3 * n_words THEN 16 ELSE 0 END)
  + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits % 4 > 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits, only_rule,
       CASE WHEN only_rule IS NOT NULL THEN (SELECT count(*) FROM b x WHERE x.fail_bits & b.fail_bits > 0) END AS only_rule_failed,
       CASE WHEN only_rule IS NOT NULL THEN (SELECT count(*) FROM b x WHERE x.fail_bits = b.fail_bits) END AS only_rule_rows
FROM (SELECT *, CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols'
      WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'stutter' WHEN 32 THEN 'long_words' END AS only_rule FROM b) b"""

ORACLES["op5_url_filter"] = r"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS r,
           coalesce(instr(url, '://') > 0, false) AS has FROM pages),
h AS (SELECT page_id, has, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/|\.html)+$', '') AS canon,
      has AND regexp_matches(host, '(^|[.-])(spam|adult|cheap|casino|free|ads)[.-]') AS bad FROM h),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN has AND canon IN (SELECT canon FROM c WHERE bad) THEN 'block' ELSE 'allow' END AS verdict FROM r"""

ORACLES["op7_chat_format"] = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et,
      row_number() OVER w AS i, lag(role) OVER w AS before FROM a
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(length(et) + CASE WHEN before = role THEN 8 ELSE 16 + length(er) + CASE WHEN i > 1 THEN 7 ELSE 0 END END)
        + 7)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

#: Unsigned CRC-32 of an array of bytes ``b``; ``t`` is the table of its 256 remainders.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""
CRC = "xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def utf8(text: str) -> str:
    """Bytes of a text whose code points are below 2048."""
    one = "CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END"
    return f"flatten(list_transform(string_split({text}, ''), lambda x: {one}))"


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op9_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^ \t\n\v\f\r]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS met FROM documents UNION SELECT c.doc_id, u.b FROM c JOIN u ON u.a = c.met),
m AS (SELECT doc_id, min(met) AS component_id FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)"""

ORACLES["op11_spelling_variants"] = f"""
WITH RECURSIVE tab AS ({CRC_TABLE}),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[a-z\u00c0-\u00ff]{{6,}}')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT w, n, {utf8("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS b FROM d),
h AS (SELECT w, n, {CRC} AS h FROM b, tab),
a AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM a WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
c AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM k),
p AS (SELECT x.word, y.word AS near, y.n AS near_n FROM c x JOIN c y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word
  AND length(x.word) = length(y.word)
  UNION SELECT c.word, v.word, v.n FROM c JOIN v ON c.cut = v.word
  UNION SELECT v.word, c.word, c.n FROM c JOIN v ON c.cut = v.word),
g AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := encode(near))) AS best FROM p GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * n THEN decode(best.near) END AS form,
      CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n FROM v LEFT JOIN g USING (word)),
z AS (SELECT word, word AS root, form AS onward FROM f
  UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON f.word = z.onward)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN z ON z.word = f.word AND z.onward IS NULL"""


def merkle_sql(levels: int = 8, group_levels: int = 2) -> str:
    """Levels are unrolled: enough for 8 ** levels rows of a language and 8 ** group_levels languages."""

    def field(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    steps, out = [], []
    for tree, n_levels in (("n", levels), ("g", group_levels)):
        for k in range(n_levels):
            steps.append(
                f"{tree}r{k} AS (SELECT tree, pos // 8 AS pos, list(node ORDER BY pos) AS run, any_value(size) AS size FROM {tree}{k} "
                f"WHERE size > 1 GROUP BY tree, pos // 8), "
                f"{tree}{k + 1} AS (SELECT tree, pos, sha256(array_to_string(run, '')) AS node, (size + 7) // 8 AS size FROM {tree}r{k} "
                f"UNION ALL SELECT * FROM {tree}{k} WHERE size = 1)"
            )
        if tree == "n":
            steps.append(
                f"s AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY first) - 1 AS rank, count(*) OVER () AS size "
                f"FROM n{levels} JOIN (SELECT tree AS t, min(encode(lang)) AS first FROM l GROUP BY tree) ON t = tree), "
                "g0 AS (SELECT 0 AS tree, rank AS pos, subroot AS node, size FROM s)"
            )
    at = "q0 AS (SELECT l.doc_id, l.node AS leaf, l.shown AS cur, l.tree, l.pos, s.rank, s.subroot, '' AS proof FROM l JOIN s USING (tree))"
    steps.append(at)
    total = levels + group_levels
    for k in range(total):
        run, tree, pos = (f"nr{k}", "q.tree", "q.pos") if k < levels else (f"gr{k - levels}", "0", "q.rank")
        up = "q.pos // 8 AS pos, q.rank" if k < levels else "q.pos, q.rank // 8 AS rank"
        before, after = f"array_to_string(run[1:{pos} % 8], '')", f"array_to_string(run[{pos} % 8 + 2:], '')"
        steps.append(
            f"q{k + 1} AS (SELECT q.doc_id, leaf, CASE WHEN run IS NULL THEN cur ELSE sha256({before} || cur || {after}) END AS cur, "
            f"q.tree, {up}, subroot, CASE WHEN run IS NULL THEN proof ELSE proof || {before} || {after} END AS proof "
            f"FROM q{k} q LEFT JOIN {run} r ON r.tree = {tree} AND r.pos = {pos} // 8)"
        )
    out.append(f"""
WITH tab AS ({CRC_TABLE}),
b AS (SELECT *, {utf8("doc_id::VARCHAR")} AS b FROM documents),
t AS (SELECT *, CASE WHEN {CRC} % 3 = 0 THEN translate(text, {AZ}) ELSE text END AS other FROM b, tab),
d AS (SELECT doc_id, lang, {leaf("text")} AS node, {leaf("other")} AS shown FROM t),
l AS (SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) AS tree,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM d),
n0 AS (SELECT tree, pos, node, count(*) OVER (PARTITION BY tree) AS size FROM l),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, (SELECT node FROM g{group_levels}) AS root, sha256(proof) AS proof_sha256, cur AS folded_root,
       cur = (SELECT node FROM g{group_levels}) AS verified FROM q{total}""")
    return out[0]


ORACLES["op13_merkle_manifest"] = merkle_sql()
