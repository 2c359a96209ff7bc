"""The core's queries as SQL of another engine, to compare results with. Written for that engine, not generated from the plans."""

from __future__ import annotations

# Fixed values, written out again so that a slip in the functions under test shows.
STOPWORDS = ["the", "a", "an", "and", "or", "of", "for", "with", "in", "on", "to", "by", "from", "at", "is", "new", "black", "white", "silver"]
COMMON_NUMBERS = ["1080", "1920", "720", "1280", "1024", "768", "480", "2000", "2007", "2008", "2009", "2010", "100", "1000", "3000", "5000", "10000"]
UNITS = [("tb|terabytes?", "gb", 1000.0), ("gb|gigabytes?", "gb", 1.0), ("mb|megabytes?", "gb", 0.001), ("ghz", "mhz", 1000.0), ("mhz", "mhz", 1.0), (r"inch|inches|in\.|\"|''", "in", 1.0), ("mp|megapixels?", "mp", 1.0), ("watts?|w", "w", 1.0)]
PACK = r"\b(\d+)\s*[- ]?\s*(?:pack|pk|pcs|pieces|count|ct)\b|\bpack of (\d+)\b|\bset of (\d+)\b|\b(\d+)\s*x\b"
CONDITION = r"\b(refurbished|refurb|renewed|used|pre-owned|open box|open-box|remanufactured)\b"
BUNDLE = r"\b(bundle|kit|with case|w/ case|combo|includes|included|\+)\b"
ACCESSORY = (
    r"\b(case|cover|cable|adapter|charger|battery|batteries|mount|bracket|stand|remote|filter|bag|strap|lens cap|lens hood|cartridge|ink|toner|belt|stylus"
    r"|earpad|ear pad|skin|screen protector|holster|dock|cradle|replacement)\b"
)
COMPATIBILITY = r"\b(for|fits|compatible with|works with|designed for|to fit)\b"
PRICE = r"([$€£])?\s*([0-9][0-9,]*(?:\.\d{1,2})?)"
SUFFIXES = (
    "p|i|k|x|gb|mb|tb|kb|hz|khz|mhz|ghz|mbps|gbps|kbps|w|mm|cm|m|in|ft|mp|rpm|bit|bits|ohm|ohms|dpi|ppm|fps|mah|wh|v|a|lb|lbs|oz|hr|hrs|ms|nm|db|cd|awg|ch|pc|pcs|pk|ct"
    "|d|g|kg|l|ml|sec|min|yr|deg|btu|cu|rms|pin|port|ports|bay|watt|watts|inch|disc|discs|pack|piece|pieces|way|zone|zones|sheet|sheets|page|pages|cup|cups|qt|gal|ton"
    "|speed|cyl|step|line|lines|hd|dvd|hour|hours|day|days|month|months|year|years|channel|channels|player|players|button|buttons|key|keys|slice|slices|quart|amp|amps"
    "|stage|stages|position|positions|setting|settings|tray|trays|door|doors|drawer|drawers|burner|burners|element|elements|rack|racks|shelf|shelves|degree|degrees"
    "|foot|feet|user|users|room|rooms|person|people|seat|seats"
)
PREFIXES = r"mpeg|mp|usb|ddr|ieee|802\.?11|h|x|wi-?fi|dvi|hdmi|dts|dolby|ac|dc|v|rs|sata|pci|pcie|dvd|cd|blu|ray|core|duo|i|gen|ver|version|type|class|cat"
# End of the fixed values.
_MIXED = r"\b([A-Za-z0-9][A-Za-z0-9/\-.]{2,}[A-Za-z0-9])\b"
_DIGITS = r"\b(\d{5,}(?:[-/]\d+)?)\b"
_BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_RID_COLUMNS = ("source", "title", "description", "brand", "model", "price", "currency")


def _clean(c: str) -> str:
    return f"trim(regexp_replace(translate(coalesce({c}, ''), '’“”', '''\"\"'), '{_BLANK}', ' ', 'g'))"


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _unit_steps(name: str, source: str, column: str) -> str:
    """CTEs that rewrite units one after the other; the last is called name and has (rid, column)."""
    out, before = [f"{name}_0 AS (SELECT rid, lower({_clean(column)}) AS s FROM {source})"], f"{name}_0"
    for i, (spellings, unit, factor) in enumerate(UNITS, 1):
        rx = rf"(^|[^a-z0-9\-])(\d+(?:\.\d+)?)\s*-?\s*(?:{spellings})\b".replace("'", "''")
        v = f"CAST(n AS DOUBLE) * {factor}"
        number = f"CASE WHEN abs({v} - round({v})) < 1e-9 THEN CAST(CAST(round({v}) AS BIGINT) AS VARCHAR) ELSE CAST(round({v}, 3) AS VARCHAR) END"
        new = f"list_transform(list_zip(regexp_extract_all(s, '{rx}', 1), list_transform(regexp_extract_all(s, '{rx}', 2), lambda n: ' ' || {number} || '{unit} ')), lambda z: z[1] || z[2])"
        out.append(f"{name}_{i} AS (SELECT rid, CASE WHEN regexp_matches(s, '{rx}') THEN array_to_string(list_transform(list_zip(string_split_regex(s, '{rx}'), list_append({new}, '')), lambda z: z[1] || z[2]), '') ELSE s END AS s FROM {before})")
        before = f"{name}_{i}"
    out.append(f"{name} AS (SELECT rid, trim(regexp_replace(regexp_replace(s, '[^a-z0-9/\\-.\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS {name} FROM {before})")
    return ",\n".join(out)


def _tokens(c: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({c}, '[/\\-.\\s]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_list(STOPWORDS)}))"


_SPEC = rf"(?i)^(?:\d+(?:\.\d+)?(?:{SUFFIXES})|(?:{PREFIXES})\d+[a-z]*)$"


def _models(c: str) -> str:
    mixed = f"list_filter(regexp_extract_all({c}, '{_MIXED}', 1), lambda m: regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, '{_SPEC}') AND NOT regexp_matches(regexp_replace(m, '[-/. ]', '', 'g'), '{_SPEC}'))"
    first = f"list_filter(list_transform({mixed}, lambda m: regexp_replace(lower(m), '[-/. ]', '', 'g')), lambda m: length(m) >= 4)"
    second = f"list_filter(list_transform(regexp_extract_all({c}, '{_DIGITS}', 1), lambda m: regexp_replace(lower(m), '[-/. ]', '', 'g')), lambda m: m NOT IN ({_list(COMMON_NUMBERS)}))"
    return f"list_concat({first}, {second})"


_once = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"
_ONE = lambda t: f"SELECT rid, {', '.join(f'min({c}) AS {c}' for c in _RID_COLUMNS)} FROM {t} WHERE rid IS NOT NULL GROUP BY rid"
_CORE = rf"regexp_extract(title, '(?is)^(.+?){COMPATIBILITY}', 1)"
_PRICE = PRICE.replace("'", "''")
_RECORDS = f"""
catalog AS (SELECT 'l' AS side, * FROM ({_ONE('catalog_left')}) UNION ALL SELECT 'r', * FROM ({_ONE('catalog_right')})),
{_unit_steps('title_norm', 'catalog', 'title')},
{_unit_steps('desc_norm', 'catalog', 'description')},
{_unit_steps('brand_plain', 'catalog', 'brand')},
texts AS (SELECT side, rid, source, {_clean('title')} AS title, {_clean('description')} AS description, {_clean('brand')} AS brand, {_clean('model')} AS model, {_clean('price')} AS price_raw, nullif({_clean('currency')}, '') AS cur FROM catalog),
named AS (SELECT t.*, n.title_norm, e.desc_norm, CASE WHEN t.brand = '' THEN lower(string_split(t.title, ' ')[1]) ELSE b.brand_plain END AS brand_norm,
  CASE WHEN {_CORE} <> '' THEN {_CORE} ELSE title END AS core FROM texts t JOIN title_norm n USING (rid) JOIN desc_norm e USING (rid) JOIN brand_plain b USING (rid)),
raw_tokens AS (SELECT *, list_concat({_models('model')}, {_models('core')}) AS m0, {_models('title')} AS t0, {_models('description')} AS d0 FROM named),
tokened AS (SELECT * EXCLUDE (m0, t0, d0), {_once('m0')} AS model_tokens, {_once('t0')} AS title_models, {_once('d0')} AS desc_models, title || ' ' || description AS whole FROM raw_tokens),
qty AS (SELECT rid, TRY_CAST(coalesce(nullif(regexp_extract(whole, '(?i){PACK}', 1), ''), nullif(regexp_extract(whole, '(?i){PACK}', 2), ''), nullif(regexp_extract(whole, '(?i){PACK}', 3), ''), nullif(regexp_extract(whole, '(?i){PACK}', 4), '')) AS BIGINT) AS q,
  lower(regexp_extract(whole, '(?i){CONDITION}', 1)) AS w FROM tokened),
records AS (SELECT t.*, regexp_replace(lower(model), '[-/. ]', '', 'g') AS explicit_model,
  list_filter(title_models, lambda m: NOT list_contains(model_tokens, m)) AS compat_model_tokens, list_filter(desc_models, lambda m: NOT list_contains(model_tokens, m)) AS desc_model_tokens,
  CASE WHEN q > 1 AND q < 1000 THEN CAST(q AS INTEGER) END AS pack_qty,
  CASE WHEN w = '' THEN 'unknown' WHEN w LIKE 'refurb%' OR w IN ('renewed', 'remanufactured') THEN 'refurbished' WHEN w IN ('used', 'pre-owned') THEN 'used' ELSE 'open_box' END AS condition,
  regexp_matches(title, '(?i){ACCESSORY}') AS accessory_hint, regexp_matches(title, '(?i){BUNDLE}') AS bundle_hint,
  TRY_CAST(replace(regexp_extract(price_raw, '{_PRICE}', 2), ',', '') AS DOUBLE) AS price,
  coalesce(cur, CASE regexp_extract(price_raw, '{_PRICE}', 1) WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' END) AS currency,
  list_zip(regexp_extract_all(title_norm, '\\b(\\d+(?:\\.\\d+)?)(gb|mhz|in|mp|w)\\b', 2), regexp_extract_all(title_norm, '\\b(\\d+(?:\\.\\d+)?)(gb|mhz|in|mp|w)\\b', 1)) AS caps
  FROM tokened t JOIN qty USING (rid)),
gold AS (SELECT DISTINCT left_rid, right_rid, label FROM gold_mapping),
positives AS (SELECT DISTINCT left_rid, right_rid FROM gold_mapping WHERE label = 1)"""
_POSTINGS = """
postings AS (SELECT side, rid, brand_norm, unnest(list_distinct(list_concat(model_tokens, desc_model_tokens, compat_model_tokens))) AS token FROM records),
rare AS (SELECT token FROM postings WHERE side = 'r' GROUP BY token HAVING count(*) <= 25),
exact AS (SELECT l.rid AS left_rid, r.rid AS right_rid, bool_or(length(l.token) >= 5 AND l.brand_norm <> '' AND l.brand_norm = r.brand_norm) AS brand_model
  FROM postings l JOIN postings r USING (token) WHERE l.side = 'l' AND r.side = 'r' AND token IN (SELECT token FROM rare) GROUP BY 1, 2)"""


def _tfidf(name: str, terms: str) -> str:
    return f"""
{name}_tf AS (SELECT side, rid, term, count(*) AS tf FROM ({terms}) GROUP BY ALL),
{name}_idf AS (SELECT term, ln((1 + (SELECT count(*) FROM records)) / (1 + count(*))) + 1 AS idf FROM {name}_tf GROUP BY term),
{name}_w AS (SELECT side, rid, term, (1 + ln(tf)) * idf AS w FROM {name}_tf JOIN {name}_idf USING (term)),
{name}_n AS (SELECT side, rid, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, rid)) AS w FROM {name}_w),
{name}_scores AS (SELECT l.rid AS left_rid, r.rid AS right_rid, sum(l.w * r.w) AS score FROM {name}_n l JOIN {name}_n r USING (term) WHERE l.side = 'l' AND r.side = 'r' GROUP BY 1, 2),
{name}_top AS (SELECT left_rid, right_rid, score FROM {name}_scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY left_rid ORDER BY round(score, 6) DESC, right_rid) <= 8)"""


_WORDS = _tfidf("words", f"SELECT side, rid, unnest({_tokens(chr(39) + chr(39) + ' || title_norm || ' + chr(39) + ' ' + chr(39) + ' || desc_norm')}) AS term FROM records")
_PADDED = "SELECT side, rid, ' ' || unnest(list_filter(string_split(title_norm, ' '), lambda w: w <> '')) || ' ' AS p FROM records"
_GRAMS = _tfidf("grams", f"SELECT side, rid, substr(p, i, n) AS term FROM (SELECT side, rid, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM (SELECT side, rid, p, unnest([3, 4, 5]) AS n FROM ({_PADDED})) WHERE n <= length(p))")
_CANDIDATES = """
found AS (SELECT left_rid, right_rid, 'exact_model' AS method FROM exact UNION SELECT left_rid, right_rid, 'brand_model' FROM exact WHERE brand_model
  UNION SELECT left_rid, right_rid, 'token_tfidf' FROM words_top UNION SELECT left_rid, right_rid, 'char_tfidf' FROM grams_top),
united AS (SELECT left_rid, right_rid, list_sort(list(method)) AS methods FROM found GROUP BY 1, 2),
candidates AS (SELECT u.left_rid, u.right_rid, array_to_string(methods, '|') AS methods, coalesce(g.score, 0) AS tfidf_char, coalesce(w.score, 0) AS tfidf_tok,
  row_number() OVER (PARTITION BY u.left_rid ORDER BY round(coalesce(g.score, 0) + coalesce(w.score, 0) + CASE WHEN list_contains(methods, 'exact_model') THEN 0.5 ELSE 0 END, 6) DESC, u.right_rid) - 1 AS rank
  FROM united u LEFT JOIN grams_scores g USING (left_rid, right_rid) LEFT JOIN words_scores w USING (left_rid, right_rid) QUALIFY rank < 16)"""
_ALL = f"WITH {_RECORDS},{_POSTINGS},{_WORDS},{_GRAMS},{_CANDIDATES}"


def _jaccard(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / greatest(1, len(list_distinct(list_concat({a}, {b}))))"


def _related(a: str, b: str, within: str) -> str:
    return f"len(list_filter(flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: [x, y]))), lambda z: length(z[1]) >= 5 AND length(z[2]) >= 5 AND (starts_with(z[1], z[2]) OR starts_with(z[2], z[1])){within})) > 0"


_NEAR = " AND abs(length(z[1]) - length(z[2])) <= {}"


def _pair(source: str) -> str:
    return f"""
paired AS (SELECT g.*, l, r, list_distinct({_tokens('l.title_norm')}) AS lw, list_distinct({_tokens('r.title_norm')}) AS rw,
  list_distinct({_tokens("l.title_norm || ' ' || l.desc_norm")}) AS la, list_distinct({_tokens("r.title_norm || ' ' || r.desc_norm")}) AS ra, l.model_tokens AS lm, r.model_tokens AS rm
  FROM {source} g JOIN records l ON l.rid = g.left_rid AND l.side = 'l' JOIN records r ON r.rid = g.right_rid AND r.side = 'r'),
parts AS (SELECT *, list_filter(lw, lambda w: regexp_matches(w, '[0-9]')) AS ln, list_filter(rw, lambda w: regexp_matches(w, '[0-9]')) AS rn, list_sort(list_intersect(lm, rm)) AS shared,
  list_filter(lm, lambda x: NOT list_contains(rm, x)) AS lo, list_filter(rm, lambda x: NOT list_contains(lm, x)) AS ro FROM paired)"""


_PAIR = _pair("gold")


def _lcs(pairs: str) -> str:
    """lcs(a, b, n): the length of the longest common subsequence of each pair (a, b) of a CTE; one number of 128 bits holds a row of the table, so a has at most 126 letters."""
    bits = " + ".join(f"bit_count(((free >> {32 * i}) & 4294967295)::BIGINT)" for i in range(4))
    return f"""
ends AS (SELECT DISTINCT CASE WHEN length(a) <= length(b) THEN a ELSE b END AS a, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS b FROM {pairs}),
letters AS (SELECT a, unnest(range(1, length(a) + 1)) AS j FROM (SELECT DISTINCT a FROM ends)),
masks AS (SELECT a, substr(a, j, 1) AS c, bit_or(1::UHUGEINT << (j - 1)::UHUGEINT) AS m FROM letters GROUP BY 1, 2),
steps AS (SELECT a, b, 0 AS i, (1::UHUGEINT << length(a)::UHUGEINT) - 1 AS free FROM ends
  UNION ALL SELECT s.a, s.b, i + 1, CASE WHEN m IS NULL THEN free ELSE ((free + (free & m)) | (free - (free & m))) & ((1::UHUGEINT << length(s.a)::UHUGEINT) - 1) END
  FROM steps s LEFT JOIN masks k ON k.a = s.a AND k.c = substr(s.b, i + 1, 1) WHERE i < length(s.b)),
halves AS (SELECT a, b, length(a) - ({bits}) AS n FROM steps WHERE i = length(b)),
lcs AS (SELECT a, b, n FROM halves UNION SELECT b, a, n FROM halves)"""


def _words_of(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


_INDEL = lambda x, a, b: f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2 * {x}.n / (length({a}) + length({b})) END"
#: titles(a, b) -> ratios(a, b, title_ratio, title_token_set, title_token_sort); long strings of windows are added for the best stretch
_SETS = f"""
sorted AS (SELECT a, b, array_to_string(list_sort({_words_of('a')}), ' ') AS sa, array_to_string(list_sort({_words_of('b')}), ' ') AS sb, list_distinct({_words_of('a')}) AS wa, list_distinct({_words_of('b')}) AS wb FROM titles),
sets AS (SELECT *, array_to_string(list_sort(list_intersect(wa, wb)), ' ') AS common, list_sort(list_filter(wa, lambda w: NOT list_contains(wb, w))) AS oa, list_sort(list_filter(wb, lambda w: NOT list_contains(wa, w))) AS ob FROM sorted),
fulls AS (SELECT *, trim(common || ' ' || array_to_string(oa, ' ')) AS fa, trim(common || ' ' || array_to_string(ob, ' ')) AS fb FROM sets)"""
_RATIOS = f"""
ratios AS (SELECT f.a, f.b, {_INDEL('x1', 'f.a', 'f.b')} AS title_ratio, {_INDEL('x2', 'sa', 'sb')} AS title_token_sort,
  CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 WHEN common <> '' AND (len(oa) = 0 OR len(ob) = 0) THEN 1.0 WHEN common = '' THEN {_INDEL('x3', 'fa', 'fb')}
    ELSE greatest({_INDEL('x3', 'fa', 'fb')}, {_INDEL('x4', 'common', 'fa')}, {_INDEL('x5', 'common', 'fb')}) END AS title_token_set
  FROM fulls f JOIN lcs x1 ON x1.a = f.a AND x1.b = f.b JOIN lcs x2 ON x2.a = sa AND x2.b = sb JOIN lcs x3 ON x3.a = fa AND x3.b = fb JOIN lcs x4 ON x4.a = common AND x4.b = fa JOIN lcs x5 ON x5.a = common AND x5.b = fb)"""
_COMPARED = "SELECT a, b FROM titles UNION SELECT sa, sb FROM fulls UNION SELECT fa, fb FROM fulls UNION SELECT common, fa FROM fulls UNION SELECT common, fb FROM fulls"
_SIMILAR = f"""titles AS (SELECT DISTINCT l.title_norm AS a, r.title_norm AS b FROM parts),{_SETS},
compared AS ({_COMPARED}),{_lcs('compared')},{_RATIOS}"""
_FLAG = lambda c: f"CAST({c} AS INTEGER)::DOUBLE"
_VALUES = lambda s, u: f"list_sort(list_distinct(list_transform(list_filter({s}.caps, lambda z: z[1] = '{u}'), lambda z: CAST(z[2] AS DOUBLE))))"
_SHOW = lambda v: f"'[' || array_to_string(list_transform({v}, lambda x: CAST(x AS VARCHAR)), ', ') || ']'"
_CONFLICTS = ", ".join(f"CASE WHEN len({_VALUES('l', u)}) > 0 AND len({_VALUES('r', u)}) > 0 AND NOT list_has_any({_VALUES('l', u)}, {_VALUES('r', u)}) THEN '{u}: ' || {_SHOW(_VALUES('l', u))} || ' vs ' || {_SHOW(_VALUES('r', u))} END" for u in ("gb", "mhz", "in", "mp", "w"))
_LEAST = lambda a, b, within: f"list_sort(list_filter(flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: [x, y]))), lambda z: length(z[1]) >= 5 AND length(z[2]) >= 5 AND (starts_with(z[1], z[2]) OR starts_with(z[2], z[1])){within}))[1]"
_RULED = f"""
related AS (SELECT *, {_LEAST('lo', 'ro', _NEAR.format(3))} AS varied, {_LEAST('lm', 'rm', _NEAR.format(2))} AS near, {_LEAST('lm', 'rm', '')} AS far FROM parts),
told AS (SELECT p.*, t.title_ratio, t.title_token_set, array_to_string(list_filter([{_CONFLICTS}], lambda x: x IS NOT NULL), '; ') AS capacity_detail,
  CASE WHEN len(lm) = 0 OR len(rm) = 0 THEN 'unknown' WHEN len(shared) > 0 AND varied IS NOT NULL THEN 'variant' WHEN len(shared) > 0 THEN 'agree' WHEN near IS NOT NULL THEN 'variant' WHEN far IS NOT NULL THEN 'prefix' ELSE 'conflict' END AS relation,
  CASE WHEN len(lm) = 0 OR len(rm) = 0 THEN 'one side has no model-like token in its title' WHEN len(shared) > 0 AND varied IS NOT NULL THEN 'shared ' || array_to_string(shared, ', ') || ' but ' || varied[1] || ' vs ' || varied[2] || ' differ by suffix'
    WHEN len(shared) > 0 THEN 'shared model token(s): ' || array_to_string(shared, ', ') WHEN near IS NOT NULL THEN near[1] || ' vs ' || near[2] || ' differ only by suffix' WHEN far IS NOT NULL THEN far[1] || ' vs ' || far[2] || ' share a prefix'
    ELSE 'no shared model token (' || CASE WHEN l.explicit_model <> '' THEN l.explicit_model ELSE coalesce(lm[1], '') END || ' vs ' || CASE WHEN r.explicit_model <> '' THEN r.explicit_model ELSE coalesce(rm[1], '') END || ')' END AS detail,
  {_jaccard('lw', 'rw')} AS jac, CASE WHEN len(ln) = 0 AND len(rn) = 0 THEN 1.0 ELSE {_jaccard('ln', 'rn')} END AS num, list_has_any(list_concat(l.desc_model_tokens, lm), list_concat(r.desc_model_tokens, rm)) AS desc_agree,
  list_has_any(l.compat_model_tokens, rm) OR list_has_any(r.compat_model_tokens, lm) AS compat, CASE WHEN l.brand_norm = '' OR r.brand_norm = '' THEN 0.5 WHEN l.brand_norm = r.brand_norm OR contains(r.title_norm, l.brand_norm) OR contains(l.title_norm, r.brand_norm) THEN 1.0 ELSE 0.0 END AS brand,
  coalesce(l.pack_qty, 1) AS lq, coalesce(r.pack_qty, 1) AS rq, l.condition <> r.condition AS other_condition, l.condition <> r.condition AND l.condition <> 'unknown' AND r.condition <> 'unknown' AS bad_condition,
  l.accessory_hint <> r.accessory_hint AS accessory, l.bundle_hint <> r.bundle_hint AS bundle, l.title_norm = r.title_norm AS exact_title FROM related p JOIN ratios t ON t.a = l.title_norm AND t.b = r.title_norm),
scored AS (SELECT *, array_to_string(list_filter([CASE WHEN relation = 'variant' THEN 'possible model variant (' || detail || ')' END, CASE WHEN compat THEN 'one title references the other''s model as a compatibility target' END,
    CASE WHEN capacity_detail <> '' THEN 'capacity conflict (' || capacity_detail || ')' END, CASE WHEN lq <> rq THEN 'quantity differs (' || lq || ' vs ' || rq || ')' END, CASE WHEN bad_condition THEN 'condition differs (' || l.condition || ' vs ' || r.condition || ')' END,
    CASE WHEN accessory THEN 'one title looks like an accessory' END, CASE WHEN bundle THEN 'one title looks like a bundle/kit' END], lambda x: x IS NOT NULL), '; ') AS material_diffs,
  least(1.0, greatest(0.0, 0.45 * title_token_set + 0.25 * title_ratio + 0.15 * jac + 0.15 * num + CASE WHEN relation = 'agree' THEN 0.25 WHEN relation = 'prefix' THEN 0.10 WHEN relation = 'variant' THEN -0.15 WHEN relation = 'conflict' THEN -0.25 WHEN desc_agree THEN 0.10 ELSE 0 END
    - CASE WHEN compat THEN 0.3 ELSE 0 END - CASE WHEN brand = 0 THEN 0.3 ELSE 0 END - CASE WHEN capacity_detail <> '' THEN 0.3 ELSE 0 END)) AS fuzzy_score,
  CASE WHEN brand = 0 AND relation <> 'agree' THEN ['different', 'rule: brand mismatch without identifier agreement'] WHEN capacity_detail <> '' THEN ['different', 'rule: explicit capacity conflict (' || capacity_detail || ')']
    WHEN compat THEN ['different', 'rule: one title cites the other''s model only as a compatibility reference (accessory/part)'] WHEN relation = 'variant' THEN ['review', 'rule: possible variant (' || detail || ')']
    WHEN relation = 'agree' AND title_token_set >= 0.6 AND lq = rq AND NOT bad_condition AND NOT accessory THEN ['match', 'rule: identifier agreement (' || detail || ') with similar titles']
    WHEN relation = 'conflict' AND title_token_set < 0.75 THEN ['different', 'rule: identifier conflict (' || detail || ') with dissimilar titles'] WHEN title_token_set < 0.45 AND title_ratio < 0.4 THEN ['different', 'rule: titles share little text'] ELSE ['review', 'rules did not resolve'] END AS rule FROM told),
decided AS (SELECT *, rule[1] AS rule_decision, rule[2] AS rule_reason, CASE WHEN capacity_detail <> '' OR (brand = 0 AND relation <> 'agree') THEN 'different' WHEN (lq <> rq OR bad_condition) AND based = 'match' THEN 'review' ELSE based END AS dec_fuzzy_rules
  FROM (SELECT *, CASE WHEN rule[1] <> 'review' THEN rule[1] WHEN fuzzy_score >= 0.98496 THEN 'match' WHEN fuzzy_score < 0.27018 THEN 'different' ELSE 'review' END AS based FROM scored))"""
#: all candidates and the labelled pairs
_TABLE = f"""{_ALL.replace('WITH', 'WITH RECURSIVE', 1)},
wanted AS (SELECT c.left_rid, c.right_rid, c.methods, c.rank FROM candidates c UNION ALL
  SELECT g.left_rid, g.right_rid, coalesce(array_to_string(u.methods, '|'), ''), NULL FROM (SELECT DISTINCT left_rid, right_rid FROM gold) g ANTI JOIN candidates c ON c.left_rid = g.left_rid AND c.right_rid = g.right_rid LEFT JOIN united u ON u.left_rid = g.left_rid AND u.right_rid = g.right_rid),
marked AS (SELECT w.*, CAST(p.left_rid IS NOT NULL AS INTEGER) AS label FROM wanted w LEFT JOIN positives p ON p.left_rid = w.left_rid AND p.right_rid = w.right_rid),{_pair('marked')},{_SIMILAR},{_RULED}"""
_EVIDENCE = """array_to_string(list_filter([CASE WHEN methods <> '' THEN 'retrieved by: ' || methods END, 'title similarity (token set): ' || printf('%.2f', round(title_token_set + 1e-9, 2)), 'model tokens: ' || detail,
  'brand: ' || CASE brand WHEN 1 THEN 'same' WHEN 0 THEN 'different' ELSE 'unknown' END, 'rule outcome: ' || rule_reason, CASE WHEN material_diffs <> '' THEN 'material differences: ' || material_diffs END], lambda x: x IS NOT NULL), ' / ')"""
#: the whole flow takes identifiers that more than eight records of either side share out of model_tokens
_PRUNED = """
common AS (SELECT DISTINCT token FROM (SELECT side, token FROM (SELECT side, unnest(model_tokens) AS token FROM every_record) GROUP BY 1, 2 HAVING count(*) > 8)),
records AS (SELECT * EXCLUDE (tokens) REPLACE (list_filter(model_tokens, lambda m: NOT list_contains(tokens, m)) AS model_tokens) FROM every_record, (SELECT coalesce(list(token), []::VARCHAR[]) AS tokens FROM common))"""
_MATCHED = f"""WITH RECURSIVE {_RECORDS.replace('records AS (SELECT t.*', 'every_record AS (SELECT t.*')},{_PRUNED},{_POSTINGS},{_WORDS},{_GRAMS},{_CANDIDATES},{_pair('candidates')},{_SIMILAR},{_RULED}"""
_WINDOWS = """
ordered AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM titles WHERE a <> '' AND b <> ''),
both_ways AS (SELECT a, b, s, t FROM ordered UNION SELECT a, b, t, s FROM ordered WHERE length(s) = length(t)),
windows AS (SELECT a, b, s, substr(t, greatest(0, e - length(s)) + 1, least(e, length(t)) - greatest(0, e - length(s))) AS w FROM (SELECT *, unnest(range(1, length(t) + length(s))) AS e FROM both_ways))"""
_JSON = lambda *fields: "'{' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} <> '' OR '{n}' = 'title' THEN '\"{n}\":' || CAST(to_json({c}) AS VARCHAR) END" for n, c in fields) + "], lambda x: x IS NOT NULL), ',') || '}'"
_EARLIER = """WITH positives AS (SELECT DISTINCT left_rid, right_rid, 1 AS hit FROM gold_mapping WHERE label = 1),
runs AS (SELECT left_rid, right_rid, decision, fuzzy_score FROM mappings UNION ALL SELECT left_rid, right_rid, 'review', fuzzy_score FROM review_queue),
pairs AS (SELECT left_rid, right_rid, min(decision) AS decision, max(fuzzy_score) AS fuzzy_score FROM runs WHERE left_rid IS NOT NULL AND right_rid IS NOT NULL GROUP BY 1, 2),
labelled AS (SELECT p.*, CAST(coalesce(hit, 0) AS INTEGER) AS label FROM pairs p LEFT JOIN positives USING (left_rid, right_rid)),
total AS (SELECT count(*) AS n_gold FROM positives)"""
_FINAL = "((decision = 'match' AND coalesce(human_decision, '') <> 'rejected') OR coalesce(human_decision, '') = 'accepted')"

_TITLES = f"catalog AS (SELECT rid, min(title) AS title FROM (SELECT rid, title FROM catalog_left UNION ALL SELECT rid, title FROM catalog_right UNION ALL SELECT rid, title FROM listings) WHERE rid IS NOT NULL GROUP BY rid), {_unit_steps('title_norm', 'catalog', 'title')}"
_SHOWN = lambda c: f"array_to_string(list_sort({c}), ' ') AS {c}"

_ASKED = '{{"accessory":["a_accessory","b_accessory","neither"],"identifiers":["agree","conflict","insufficient"],"offer_diff":["differ","same","not_stated"],"same_model":["same","different","insufficient"],"variant_conflict":["conflict","no_conflict","not_stated"],"verdict":["same","different","insufficient"]}}'.replace("{{", "{").replace("}}", "}")
_FIELDS = lambda r: _JSON(*[(n, f"{r}.{c}") for n, c in (("title", "title"), ("description", "description"), ("brand", "brand"), ("model", "model"), ("price", "price_raw"))])
#: the stand-in for a judge compares the words of both titles
_JUDGED = f"""{_TABLE},
states AS (SELECT left_rid, right_rid, rule_decision, '{{"a":' || {_FIELDS('l')} || ',"b":' || {_FIELDS('r')} || '}}' AS state, list_distinct(list_filter(string_split(lower(l.title), ' '), lambda w: w <> '')) AS x, list_distinct(list_filter(string_split(lower(r.title), ' '), lambda w: w <> '')) AS y FROM decided),
judged AS (SELECT *, round(len(list_intersect(x, y)) / greatest(1, len(list_distinct(list_concat(x, y)))), 6) AS p FROM states)"""
_SPLIT = """WITH RECURSIVE links AS (SELECT DISTINCT 'L:' || left_rid AS a, 'R:' || right_rid AS b FROM gold_mapping WHERE label = 1), e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  nodes AS (SELECT 'L' AS side, rid FROM catalog_left UNION SELECT 'R', rid FROM catalog_right), reached AS (SELECT side || ':' || rid AS n, side || ':' || rid AS m FROM nodes UNION SELECT r.n, e.b FROM reached r JOIN e ON r.m = e.a),
  splits AS (SELECT substr(n, 1, 1) AS side, substr(n, 3) AS rid, CASE WHEN right(min(m), 1) IN ('0', '1', '2', '3') THEN 'dev' ELSE 'test' END AS split FROM reached GROUP BY n)"""

ORACLES: dict[str, str] = {
    "clean_normalize": f"WITH {_TITLES} SELECT rid, {_clean('title')} AS title, title_norm, regexp_replace(lower({_clean('title')}), '[-/. ]', '', 'g') AS squeezed FROM catalog JOIN title_norm USING (rid)",
    "tokens_stopwords": f"WITH {_TITLES} SELECT rid, array_to_string({_tokens('title_norm')}, ' ') AS tokens FROM title_norm",
    "model_tokens": f"WITH {_RECORDS} SELECT rid, explicit_model, {_SHOWN('model_tokens')}, {_SHOWN('compat_model_tokens')}, {_SHOWN('desc_model_tokens')} FROM records",
    "prune_common_tokens": f"WITH {_RECORDS}, each AS (SELECT side, unnest(model_tokens) AS token FROM records), common AS (SELECT side, token, count(*) AS df FROM each GROUP BY 1, 2 HAVING count(*) > 1) SELECT token, arg_max(df, side) AS df FROM common GROUP BY token",
    "record_attributes": f"""WITH {_RECORDS} SELECT rid, price, currency, brand_norm, pack_qty, condition, array_to_string(list_transform(list_sort(list_distinct(list_transform(caps, lambda z: z[1]))),
  lambda u: u || '=' || array_to_string(list_transform(list_sort(list_distinct(list_transform(list_filter(caps, lambda z: z[1] = u), lambda z: CAST(z[2] AS DOUBLE)))), lambda v: CAST(round(v, 3) AS VARCHAR)), ',')), ';') AS capacities, accessory_hint, bundle_hint FROM records""",
    "block_exact_model": f"WITH {_RECORDS},{_POSTINGS} SELECT left_rid, right_rid, brand_model FROM exact",
    "block_token_tfidf": f"WITH {_RECORDS},{_WORDS} SELECT left_rid, right_rid, round(score, 6) AS score FROM words_top",
    "block_char_tfidf": f"WITH {_RECORDS},{_GRAMS} SELECT left_rid, right_rid, round(score, 6) AS score FROM grams_top",
    "candidates_union": f"{_ALL} SELECT left_rid, right_rid, methods, round(tfidf_char, 6) AS tfidf_char, round(tfidf_tok, 6) AS tfidf_tok, rank FROM candidates",
    "candidate_recall": f"{_ALL} SELECT (SELECT count(*) FROM positives) AS gold, (SELECT count(*) FROM positives JOIN candidates USING (left_rid, right_rid)) AS found, (SELECT count(*) FROM positives JOIN candidates USING (left_rid, right_rid)) / greatest(1, (SELECT count(*) FROM positives)) AS recall, (SELECT count(*) FROM candidates) AS n_candidate_pairs",
    "retrieval_misses": f"{_ALL} SELECT p.left_rid, p.right_rid FROM positives p ANTI JOIN candidates c ON p.left_rid = c.left_rid AND p.right_rid = c.right_rid",
    "title_similarity": f"""WITH RECURSIVE {_RECORDS},{_PAIR},titles AS (SELECT DISTINCT l.title_norm AS a, r.title_norm AS b FROM parts),{_SETS},{_WINDOWS},
compared AS ({_COMPARED} UNION SELECT s, w FROM windows),{_lcs('compared')},{_RATIOS},
stretches AS (SELECT w.a, w.b, max({_INDEL('x', 's', 'w')}) AS best FROM windows w JOIN lcs x ON x.a = s AND x.b = w.w GROUP BY 1, 2)
SELECT p.left_rid, p.right_rid, round(title_ratio, 6) AS title_ratio, round(title_token_set, 6) AS title_token_set, round(title_token_sort, 6) AS title_token_sort, round(coalesce(best, CAST(l.title_norm = r.title_norm AS INTEGER)), 6) AS title_partial
FROM parts p JOIN ratios t ON t.a = l.title_norm AND t.b = r.title_norm LEFT JOIN stretches x ON x.a = l.title_norm AND x.b = r.title_norm""",
    "pair_rules": f"{_TABLE} SELECT left_rid, right_rid, label, rule_decision, rule_reason, round(fuzzy_score, 6) AS fuzzy_score, material_diffs, {_EVIDENCE} AS evidence FROM decided",
    "pair_decisions": f"""{_TABLE} SELECT left_rid, right_rid, CASE WHEN exact_title OR (relation = 'agree' AND length(regexp_extract(detail, 'shared model token\\(s\\): (\\S+)', 1)) >= 5) THEN 'match' ELSE 'different' END AS dec_exact, rule_decision, dec_fuzzy_rules FROM decided""",
    "match_catalogs": f"{_MATCHED} SELECT left_rid, right_rid, rank, methods, rule_decision, round(fuzzy_score, 6) AS fuzzy_score, material_diffs, dec_fuzzy_rules AS decision FROM decided",
    "error_breakdown": f"""{_TABLE} SELECT error, category, count(*) AS count FROM (SELECT CASE WHEN dec_fuzzy_rules = 'match' AND label = 0 THEN 'false_match' WHEN dec_fuzzy_rules <> 'match' AND label = 1 THEN 'missed_match' END AS error,
  CASE WHEN capacity_detail <> '' THEN 'capacity/variant' WHEN accessory THEN 'accessory vs product' WHEN lq <> rq THEN 'quantity/multipack' WHEN bad_condition THEN 'condition' WHEN bundle THEN 'bundle' WHEN relation = 'conflict' THEN 'model number differs' WHEN relation = 'unknown' THEN 'identifier missing' ELSE 'wording' END AS category FROM decided) WHERE error IS NOT NULL GROUP BY 1, 2""",
    "records_flat": f"""WITH {_RECORDS}, named_units AS (SELECT *, list_transform(caps, lambda z: z[1]) AS named_caps FROM records WHERE side = 'l')
SELECT source, rid, title, description, brand, model, price_raw, title_norm, desc_norm, price, currency, brand_norm, explicit_model, array_to_string(model_tokens, ' ') AS model_tokens, pack_qty, condition,
  '{{' || array_to_string(list_transform({_once('named_caps')}, lambda u: '"' || u || '":[' || array_to_string(list_transform(list_sort(list_distinct(list_transform(list_filter(caps, lambda z: z[1] = u), lambda z: CAST(z[2] AS DOUBLE)))), lambda v: CAST(v AS VARCHAR)), ',') || ']'), ',') || '}}' AS capacities,
  accessory_hint, bundle_hint, array_to_string(compat_model_tokens, ' ') AS compat_model_tokens, array_to_string(desc_model_tokens, ' ') AS desc_model_tokens FROM named_units""",
    "visible_fields": f"WITH {_RECORDS} SELECT rid, {_JSON(('title', 'title'), ('description', 'description'), ('brand', 'brand'), ('model', 'model'), ('price', 'price_raw'))} AS fields FROM records",
    "pair_attributes": f"""WITH {_RECORDS},{_PAIR} SELECT left_rid, right_rid, label,
  CASE WHEN len(lm) = 0 OR len(rm) = 0 THEN 'unknown' WHEN len(shared) > 0 AND {_related('lo', 'ro', _NEAR.format(3))} THEN 'variant' WHEN len(shared) > 0 THEN 'agree' WHEN {_related('lm', 'rm', _NEAR.format(2))} THEN 'variant' WHEN {_related('lm', 'rm', '')} THEN 'prefix' ELSE 'conflict' END AS model_relation,
  round({_jaccard('lw', 'rw')}, 6) AS title_jaccard, round({_jaccard('la', 'ra')}, 6) AS full_jaccard, CASE WHEN len(ln) = 0 AND len(rn) = 0 THEN 1.0 ELSE round({_jaccard('ln', 'rn')}, 6) END AS num_overlap,
  CASE WHEN l.brand_norm = '' OR r.brand_norm = '' THEN 0.5 ELSE {_FLAG('l.brand_norm = r.brand_norm OR contains(r.title_norm, l.brand_norm) OR contains(l.title_norm, r.brand_norm)')} END AS brand_same,
  {_FLAG('list_has_any(list_concat(l.desc_model_tokens, lm), list_concat(r.desc_model_tokens, rm))')} AS desc_model_agree, {_FLAG('list_has_any(l.compat_model_tokens, rm) OR list_has_any(r.compat_model_tokens, lm)')} AS compat_ref,
  {_FLAG("len(list_filter(['gb', 'mhz', 'in', 'mp', 'w'], lambda u: len(list_filter(l.caps, lambda z: z[1] = u)) > 0 AND len(list_filter(r.caps, lambda z: z[1] = u)) > 0 AND NOT list_has_any(list_transform(list_filter(l.caps, lambda z: z[1] = u), lambda z: CAST(z[2] AS DOUBLE)), list_transform(list_filter(r.caps, lambda z: z[1] = u), lambda z: CAST(z[2] AS DOUBLE))))) > 0")} AS capacity_conflict,
  {_FLAG('coalesce(l.pack_qty, 1) <> coalesce(r.pack_qty, 1)')} AS qty_conflict, {_FLAG("l.condition <> r.condition AND l.condition <> 'unknown' AND r.condition <> 'unknown'")} AS condition_conflict,
  {_FLAG('l.accessory_hint <> r.accessory_hint')} AS accessory_mismatch, {_FLAG('l.bundle_hint <> r.bundle_hint')} AS bundle_mismatch,
  CASE WHEN l.price > 0 AND r.price > 0 AND l.currency IS NOT DISTINCT FROM r.currency THEN round(least(l.price, r.price) / greatest(l.price, r.price), 6) ELSE -1.0 END AS price_ratio, l.title_norm = r.title_norm AS exact_title FROM parts""",
    "judge_cache_keys": f"""WITH {_RECORDS} SELECT g.left_rid, g.right_rid, sha256('{{"m":"stub","q":{_ASKED},"v":"v1","s":' || l.title || '|' || r.title || '}}') AS key FROM gold g JOIN records l ON l.rid = g.left_rid AND l.side = 'l' JOIN records r ON r.rid = g.right_rid AND r.side = 'r'""",
    "label_pairs": f"{_EARLIER} SELECT left_rid, right_rid, decision, fuzzy_score, label FROM labelled",
    "confusion_metrics": f"""{_EARLIER}, s AS (SELECT count(*) AS pairs, count(*) FILTER (decision = 'match' AND label = 1) AS tp, count(*) FILTER (decision = 'match' AND label = 0) AS fp, count(*) FILTER (label = 1) AS pos,
  count(*) FILTER (decision <> 'review') AS auto, count(*) FILTER (decision <> 'review' AND (decision = 'match') = (label = 1)) AS right_ FROM labelled)
SELECT pairs, tp, fp, pos - tp AS fn_pool, n_gold - tp AS fn_e2e, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / greatest(1, pos), 9) AS recall_pool, round(tp / greatest(1, n_gold), 9) AS recall_e2e,
  CASE WHEN tp > 0 THEN round(2 * (tp / (tp + fp)) * (tp / greatest(1, n_gold)) / (tp / (tp + fp) + tp / greatest(1, n_gold)), 9) ELSE 0.0 END AS f1_e2e, round((pairs - auto) / nullif(pairs, 0), 9) AS review_fraction, pairs - auto AS review_count, round(auto / nullif(pairs, 0), 9) AS auto_coverage, round(right_ / nullif(auto, 0), 9) AS auto_accuracy FROM s, total""",
    "pr_curve": f"""{_EARLIER}, grid AS (SELECT round(0.3 + i * 0.02, 6) AS threshold FROM range(36) t(i))
SELECT threshold, count(l.label) FILTER (l.label = 1) AS tp, count(l.label) FILTER (l.label = 0) AS fp, round(count(l.label) FILTER (l.label = 1) / nullif(count(l.label), 0), 9) AS precision, round(count(l.label) FILTER (l.label = 1) / greatest(1, any_value(n_gold)), 9) AS recall_e2e
FROM grid CROSS JOIN total LEFT JOIN labelled l ON l.fuzzy_score >= threshold - 1e-11 GROUP BY threshold""",
    "choose_thresholds": f"""{_EARLIER}, known AS (SELECT p.fuzzy_score, g.label FROM pairs p JOIN (SELECT DISTINCT left_rid, right_rid, label FROM gold_mapping) g USING (left_rid, right_rid)), scores AS (SELECT fuzzy_score AS s, sum(label) AS p, count(*) AS n FROM known WHERE fuzzy_score IS NOT NULL GROUP BY 1),
  curve AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM scores),
  best AS (SELECT coalesce((SELECT s FROM curve WHERE tp >= 0.99 * seen ORDER BY tp DESC, s DESC LIMIT 1), 1.01) AS hi),
  up AS (SELECT s, sum(p) OVER (ORDER BY s) AS upto, sum(p) OVER () AS every FROM scores WHERE p > 0),
  low AS (SELECT coalesce(min(s), 0.0) AS low FROM up WHERE upto > floor(every * 0.01))
SELECT hi, least(hi, low) AS lo FROM best, low""",
    "product_groups": """WITH RECURSIVE links AS (SELECT DISTINCT 'L:' || left_rid AS a, 'R:' || right_rid AS b FROM gold_mapping WHERE label = 1), e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  nodes AS (SELECT 'L' AS side, rid FROM catalog_left UNION SELECT 'R', rid FROM catalog_right), reached AS (SELECT side || ':' || rid AS n, side || ':' || rid AS m FROM nodes UNION SELECT r.n, e.b FROM reached r JOIN e ON r.m = e.a)
SELECT substr(n, 1, 1) AS side, substr(n, 3) AS rid, min(m) AS "group" FROM reached GROUP BY n""",
    "split_manifest_rows": f"{_SPLIT} SELECT s.source, s.rid, split FROM (SELECT 'L' AS side, rid, min(source) AS source FROM catalog_left GROUP BY rid UNION ALL SELECT 'R', rid, min(source) FROM catalog_right GROUP BY rid) s JOIN splits USING (side, rid)",
    "gold_by_split": f"{_SPLIT} SELECT split, count(*) AS n FROM (SELECT DISTINCT left_rid, right_rid FROM gold_mapping WHERE label = 1) g JOIN splits s ON s.side = 'L' AND s.rid = g.left_rid GROUP BY split",
    "metrics_by_split": f"""{_SPLIT}, {_EARLIER.removeprefix('WITH ')} SELECT split, count(*) AS pairs, count(*) FILTER (decision = 'match' AND label = 1) AS tp, count(*) FILTER (decision = 'match' AND label = 0) AS fp, count(*) FILTER (decision = 'review') AS review_count
  FROM labelled l LEFT JOIN splits s ON s.side = 'L' AND s.rid = l.left_rid GROUP BY split""",
    "matched_precision": f"""{_EARLIER}, known AS (SELECT p.fuzzy_score AS s, g.label FROM pairs p JOIN (SELECT DISTINCT left_rid, right_rid, label FROM gold_mapping) g USING (left_rid, right_rid) WHERE p.fuzzy_score IS NOT NULL),
  scores AS (SELECT s, sum(label) AS p, count(*) AS n FROM known GROUP BY 1), curve AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM scores),
  targets AS (SELECT unnest([0.95, 0.99])::DOUBLE AS target), best AS (SELECT target, coalesce((SELECT s FROM curve WHERE tp >= target * seen ORDER BY tp DESC, s DESC LIMIT 1), 1.01) AS hi FROM targets),
  up AS (SELECT s, sum(p) OVER (ORDER BY s) AS upto, sum(p) OVER () AS every FROM scores WHERE p > 0), low AS (SELECT coalesce(min(s), 0.0) AS low FROM up WHERE upto > floor(every * 0.01)),
  bounds AS (SELECT target, hi, least(hi, low) AS lo FROM best, low)
SELECT 'fuzzy' AS method, target AS target_precision, round(hi, 9) AS hi, round(lo, 9) AS lo, count(s) AS pairs, count(s) FILTER (s >= hi AND label = 1) AS tp, count(s) FILTER (s >= hi AND label = 0) AS fp, count(s) FILTER (s < hi AND s >= lo) AS review_count FROM bounds LEFT JOIN known ON true GROUP BY target, hi, lo""",
    "decision_counts": f"{_EARLIER} SELECT decision, count(*) AS n FROM labelled GROUP BY decision",
    "judge_stub_hybrid": f"""{_JUDGED}, given AS (SELECT *, CASE WHEN rule_decision = 'review' THEN p * (1 - 0.5 * greatest((1 - p) / 2, 0.0)) END AS score FROM judged),
  said AS (SELECT *, CASE WHEN score IS NULL THEN 'review' WHEN score >= 0.5 THEN 'match' WHEN score < 0.1 THEN 'different' ELSE 'review' END AS dec_judge FROM given)
SELECT left_rid, right_rid, rule_decision, round(score, 6) AS judge_score, dec_judge, CASE WHEN rule_decision <> 'review' THEN rule_decision ELSE dec_judge END AS dec_hybrid FROM said""",
    "judge_spending": f"""{_JUDGED} SELECT count(*) AS attempts, CAST(sum(length(state) // 4) AS BIGINT) AS input_tokens, 60 * count(*) AS output_tokens, 0::BIGINT AS failures, count(*) AS answered, round(sum(length(state) // 4) / 1e6 * 0.042, 5) AS estimated_usd
FROM (SELECT DISTINCT state FROM judged WHERE rule_decision = 'review')""",
    "p4_spellings": """WITH units(spellings, kind, scale, offs) AS (VALUES
  ('mm millimetre millimetres millimeter millimeters', 'length', 1.0, 0.0), ('cm centimetre centimetres centimeter centimeters', 'length', 10.0, 0.0), ('m metre metres meter meters', 'length', 1000.0, 0.0), ('in inch inches " '''' ” ″', 'length', 25.4, 0.0),
  ('ft foot feet '' ’ ′', 'length', 304.8, 0.0), ('yd yds yard yards', 'length', 914.4, 0.0), ('kg kgs kilo kilos kilogram kilograms', 'mass', 1000.0, 0.0), ('g gr gm gms gram grams', 'mass', 1.0, 0.0), ('mg milligram milligrams', 'mass', 0.001, 0.0), ('oz ounce ounces', 'mass', 28.349523125, 0.0), ('lb lbs pound pounds', 'mass', 453.59237, 0.0),
  ('ml millilitre millilitres milliliter milliliters', 'volume', 1.0, 0.0), ('cl centilitre centilitres centiliter centiliters', 'volume', 10.0, 0.0), ('l ltr ltrs litre litres liter liters', 'volume', 1000.0, 0.0), ('floz fluidounce fluidounces', 'volume', 29.5735295625, 0.0),
  ('pint pints', 'volume', 473.176473, 0.0), ('qt qts quart quarts', 'volume', 946.352946, 0.0), ('gal gals gallon gallons', 'volume', 3785.411784, 0.0), ('w watt watts', 'power', 1.0, 0.0), ('kw kilowatt kilowatts', 'power', 1000.0, 0.0), ('mb megabyte megabytes', 'storage', 1.0, 0.0), ('gb gigabyte gigabytes', 'storage', 1000.0, 0.0), ('tb terabyte terabytes', 'storage', 1000000.0, 0.0),
  ('c °c ºc degc degreesc degreecelsius degreescelsius degreescentigrade celsius', 'temperature', 1.0, 0.0), ('f °f ºf degf degreesf degreefahrenheit degreesfahrenheit fahrenheit', 'temperature', 5.0 / 9, -160.0 / 9))
SELECT unnest(string_split(spellings, ' ')) AS spelling, kind, scale::DOUBLE AS scale, offs::DOUBLE AS "offset" FROM units WHERE kind IN (SELECT kind FROM target_units)""",
    "split_stats": "SELECT split, source, count(*) AS n FROM split_manifest GROUP BY 1, 2",
    "export_mappings": f"SELECT left_rid, right_rid, left_title, right_title, decision, human_decision, fuzzy_score, jev_score, material_diffs FROM mappings WHERE {_FINAL}",
    "export_unmatched": f"""WITH done AS (SELECT left_rid, right_rid FROM mappings WHERE {_FINAL}), a AS (SELECT rid, min(source) AS source, min(title) AS title FROM catalog_left GROUP BY rid), b AS (SELECT rid, min(source) AS source, min(title) AS title FROM catalog_right GROUP BY rid)
SELECT source, rid, title FROM a WHERE NOT EXISTS (SELECT 1 FROM done WHERE left_rid = rid) UNION ALL SELECT source, rid, title FROM b WHERE NOT EXISTS (SELECT 1 FROM done WHERE right_rid = rid)""",
    "export_review_queue": "SELECT left_rid, right_rid, left_title, right_title, human_decision, fuzzy_score, jev_score, material_diffs, rule_reason FROM review_queue",
    "pair_search": r"SELECT left_rid, right_rid, decision, fuzzy_score, material_diffs FROM mappings WHERE (regexp_matches(left_title, '(?i)chest\s+freezer') OR regexp_matches(right_title, '(?i)chest\s+freezer')) AND decision IN ('match', 'review') AND length(material_diffs) > 0",
}
