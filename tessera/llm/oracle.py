"""SQL equivalents, for DuckDB, of the corpus queries that SQL can express."""

from __future__ import annotations

from tessera.llm import decontaminate as dc
from tessera.llm import fill_in_middle as fm
from tessera.llm import minhash as mh
from tessera.llm import quality_rules as qr
from tessera.llm import substring_dedup, suffix_dedup

_GAP = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}'), lambda x: x <> '')"


def _islands(width: int) -> str:
    """From win (rid, i, h; starts from 1) to spans (rid, lo, hi): maximal runs under repeated windows."""
    return f"""dup AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
st AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM win WHERE h IN (SELECT h FROM dup)),
isl AS (SELECT rid, i, sum(CASE WHEN p IS NULL OR i > p + {width} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS g FROM st),
spans AS (SELECT rid, min(i) AS lo, max(i) + {width} AS hi FROM isl GROUP BY rid, g),
tot AS (SELECT rid, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY rid)"""


def substring_sql(width: int = substring_dedup.WIDTH) -> str:
    return f"""WITH k AS (SELECT doc_id, w, len(w)::BIGINT AS n, row_number() OVER () AS rid FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
win AS (SELECT rid, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, n - {width - 2})) AS i FROM k WHERE n >= {width})),
{_islands(width)},
ws AS (SELECT rid, unnest(w) AS word, unnest(range(1, n + 1)) AS pos FROM k),
kept AS (SELECT ws.rid, string_agg(word, ' ' ORDER BY pos) AS t FROM ws WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.rid = ws.rid AND ws.pos >= s.lo AND ws.pos < s.hi) GROUP BY ws.rid)
SELECT k.doc_id, k.n AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM k LEFT JOIN tot USING (rid) LEFT JOIN kept USING (rid)"""


def suffix_sql(width: int = suffix_dedup.WIDTH) -> str:
    """Bytes as pairs of hexadecimal digits."""
    return f"""WITH k AS (SELECT doc_id, x, (length(x) // 2)::BIGINT AS n, row_number() OVER () AS rid FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents)),
win AS (SELECT rid, i, md5(substr(x, 2 * i - 1, {2 * width})) AS h FROM (SELECT rid, x, unnest(range(1, n - {width - 2})) AS i FROM k WHERE n >= {width})),
{_islands(width)},
cuts AS (SELECT rid, lo, hi, lag(hi, 1, 1) OVER (PARTITION BY rid ORDER BY lo) AS beg FROM spans),
pieces AS (SELECT rid, lo, substr(x, 2 * beg - 1, 2 * (lo - beg)) AS t FROM cuts JOIN k USING (rid)
  UNION ALL SELECT rid, n + 2, substr(x, 2 * max_hi - 1) FROM (SELECT rid, max(hi) AS max_hi FROM spans GROUP BY rid) JOIN k USING (rid)),
kept AS (SELECT rid, string_agg(t, '' ORDER BY lo) AS t FROM pieces GROUP BY rid)
SELECT k.doc_id, k.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.t, k.x))) AS kept_sha256
FROM k LEFT JOIN tot USING (rid) LEFT JOIN kept USING (rid)"""


def quality_sql() -> str:
    steps = ", ".join("(" + ", ".join([str(step), *(f"{qr.cutoff(rule, step)}::DOUBLE" for rule in qr.RULES)]) + ")" for step in range(qr.STEPS))
    above = " OR ".join(f"{rule} > cut_{rule}" for rule in qr.RULES)
    risk = qr.RISK
    w = qr.WINDOW
    return f"""WITH k AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {_WORDS} AS w, row_number() OVER () AS rid FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + {w - 1}], ' ') AS h FROM (SELECT rid, w, unnest(range(1, len(w) - {w - 2})) AS i FROM k WHERE len(w) > {w})),
again AS (SELECT rid, h FROM win GROUP BY rid, h HAVING count(*) > 1),
st AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM win JOIN again USING (rid, h)),
rep AS (SELECT rid, sum(least({w}, coalesce(i - p, {w})))::BIGINT AS n_repeat_words FROM st GROUP BY rid),
a AS (SELECT rid, doc_id, lang, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, length(t) - length(translate(t, '!', '')) AS marks, length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')) AS capitals,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS lines FROM k),
f AS (SELECT a.*, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM a LEFT JOIN rep USING (rid)),
s AS (SELECT *, n_words < {qr.BASE_WORDS} OR 100 * n_repeat_words > {qr.BASE_REPEAT_PERCENT} * n_words AS base_failed, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_rate,
  CASE WHEN word_chars > 0 THEN capitals::DOUBLE / word_chars ELSE 0 END AS capital_rate, CASE WHEN n_words > 0 THEN marks::DOUBLE / n_words ELSE 0 END AS mark_rate,
  CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS line_rate, CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_rate FROM f),
lab AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
good AS (SELECT doc_id, lang AS stratum, {", ".join(f"max({r}) AS {r}" for r in qr.RULES)} FROM s JOIN lab USING (doc_id) WHERE NOT base_failed GROUP BY 1, 2),
cuts(step, {", ".join(f"cut_{rule}" for rule in qr.RULES)}) AS (VALUES {steps}),
c AS (SELECT stratum, step, count(*) AS n, count_if({above})::BIGINT AS k FROM good CROSS JOIN cuts GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN k > n * {risk} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END AS p FROM c),
o AS (SELECT *, min((p <= {qr.LEVEL} / (SELECT count(DISTINCT stratum) FROM c))::INT) OVER (PARTITION BY stratum ORDER BY step) = 1 AS certified FROM p),
b AS (SELECT stratum, cuts.* FROM (SELECT stratum, max(step) AS step FROM o WHERE certified GROUP BY 1) JOIN cuts USING (step)),
bad AS (SELECT DISTINCT s.rid FROM s JOIN b ON s.lang = b.stratum WHERE {above})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM s"""


def decontamination_sql() -> str:
    units = ", ".join(f"'{u}'" for u in dc.UNITS)
    n, w = dc.WINDOW, dc.WINDOW - 1

    def tokens(table: str, key: str, where: str, names: bool = True) -> str:
        raw = r"regexp_extract_all(coalesce(text, ''), '(?:\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{N}])+')"
        kind = rf"list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '^\p{{N}}') THEN '{dc.NUMBER}' WHEN {names} AND regexp_matches(x, '^\p{{Lu}}\p{{Ll}}') THEN '{dc.NAME}' ELSE lower(x) END)"
        unit = f"list_transform(t0, lambda x, i: CASE WHEN i > 1 AND t0[i - 1] = '{dc.NUMBER}' AND x IN ({units}) THEN '{dc.UNIT}' ELSE x END)"
        return f"{where} AS (SELECT id, raw, {unit} AS tpl FROM (SELECT id, raw, {kind} AS t0 FROM (SELECT {key} AS id, {raw} AS raw FROM {table})))"

    slot = f"IN ('{dc.NAME}', '{dc.NUMBER}', '{dc.UNIT}')"
    return f"""WITH {tokens('benchmark', 'item_id', 'bn')}, {tokens('benchmark', 'item_id', 'bp', False)}, bt AS (SELECT * FROM bn UNION ALL SELECT * FROM bp), {tokens('documents', 'doc_id', 'dt')},
cls AS (SELECT tpl, arg_min(raw, id) AS raw, list(DISTINCT id) AS items, row_number() OVER () AS c FROM bt GROUP BY tpl),
iw AS (SELECT c, i AS ipos, array_to_string(tpl[i:i + {w}], ' ') AS h, tpl, raw FROM (SELECT *, unnest(range(1, len(tpl) - {n - 2})) AS i FROM cls WHERE len(tpl) >= {n}) WHERE len(list_filter(tpl[i:i + {w}], lambda x: x NOT {slot})) >= {dc.LITERALS}),
size AS (SELECT c, count(*) AS n_windows FROM iw GROUP BY c),
dk AS (SELECT *, row_number() OVER () AS rid FROM dt),
dw AS (SELECT rid, i AS pos, array_to_string(tpl[i:i + {w}], ' ') AS h FROM (SELECT *, unnest(range(1, len(tpl) - {n - 2})) AS i FROM dk WHERE len(tpl) >= {n})),
hit AS (SELECT DISTINCT rid, c, pos - ipos AS shift, ipos FROM dw JOIN iw USING (h)),
run AS (SELECT rid, c, shift, min(ipos) AS lo, max(ipos) + {w} AS hi FROM hit GROUP BY 1, 2, 3),
sl AS (SELECT r.rid, r.c, r.shift, lower(cls.raw[j]) AS a, lower(dk.raw[j + r.shift]) AS b FROM (SELECT *, unnest(range(lo, hi + 1)) AS j FROM run) r JOIN cls USING (c) JOIN dk USING (rid) WHERE cls.tpl[j] {slot}),
bad AS (SELECT rid, c, shift FROM (SELECT DISTINCT * FROM sl) GROUP BY 1, 2, 3 HAVING count(*) > count(DISTINCT a)),
ok AS (SELECT rid, c, count(DISTINCT ipos) AS n_matched FROM hit h WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.rid = h.rid AND b.c = h.c AND b.shift = h.shift) GROUP BY 1, 2),
res AS (SELECT dk.id AS doc_id, unnest(cls.items) AS item_id, n_windows, n_matched FROM ok JOIN size USING (c) JOIN cls USING (c) JOIN dk USING (rid) WHERE n_matched >= {dc.SIMILARITY} * n_windows)
SELECT doc_id, item_id, max(n_windows)::BIGINT AS n_windows, max(n_matched)::BIGINT AS n_matched, max(n_matched) / max(n_windows) AS similarity, true AS contaminated FROM res GROUP BY 1, 2"""


def fill_in_middle_sql() -> str:
    """Restored texts are the parts between the markers of the output."""
    number = lambda i: f"('0x' || substr(digest, {8 * i + 1}, 8))::BIGINT"
    p, s, m = fm.PREFIX, fm.SUFFIX, fm.MIDDLE
    return f"""WITH k AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('{fm.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
h AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, {number(0)} AS x, {number(1)} AS y, {number(2)} AS z, {number(3)} AS q FROM k),
c AS (SELECT *, least(x % (n + 1), y % (n + 1)) AS a, greatest(x % (n + 1), y % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR z % 100 >= {fm.RATE} THEN 'plain' WHEN q % 100 < {fm.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
d AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid WHEN 'spm' THEN '{s}' || suf || '{p}' || pre || '{m}' || mid ELSE t END AS out FROM d),
r AS (SELECT *, regexp_extract(out, '(?s)^<.>(.*)<.>(.*){m}(.*)$', 1) AS one, regexp_extract(out, '(?s)^<.>(.*)<.>(.*){m}(.*)$', 2) AS two, regexp_extract(out, '(?s)^<.>(.*)<.>(.*){m}(.*)$', 3) AS three FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars, sha256(out) AS output_sha256,
  sha256(CASE form WHEN 'psm' THEN one || three || two WHEN 'spm' THEN two || three || one ELSE out END) AS restored_sha256 FROM r"""


def minhash_sql() -> str:
    """All pairs of different sets that share a shingle; components by growing reach."""
    w = mh.SHINGLE
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE k AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '{_GAP}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, rid, CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {w} THEN [md5(array_to_string(w, ' '))] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {w - 2}), lambda i: md5(array_to_string(w[i:i + {w - 1}], ' '))))) END AS x FROM k),
c AS (SELECT x, min(rid) AS c FROM s GROUP BY x),
m AS (SELECT doc_id, rid, len(s.x)::BIGINT AS n, CASE WHEN len(s.x) > 0 THEN c ELSE rid END AS c FROM s JOIN c ON s.x = c.x),
e AS (SELECT c, len(x) AS n, unnest(x) AS v FROM c WHERE len(x) > 0),
p AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.v = b.v AND a.c < b.c AND 100 * least(a.n, b.n) >= {mh.SIMILAR} * greatest(a.n, b.n) GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {mh.SIMILAR} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(c, t) AS (SELECT DISTINCT c, c FROM m UNION SELECT r.c, l.b FROM r JOIN l ON r.t = l.a),
i AS (SELECT r.c, min(doc_id) AS component_id FROM r JOIN m ON r.t = m.c GROUP BY r.c)
SELECT doc_id, n AS n_shingles, component_id, coalesce(doc_id = component_id, component_id IS NULL) AS kept FROM m JOIN i USING (c)"""
