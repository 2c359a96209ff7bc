"""SQL of another engine for queries of this subpackage that SQL can say. Its regular expressions know no lookaround, so boundaries are captured."""

from __future__ import annotations

_MARK = r"(?:…|\x{FFFD}|\[(?:more|\.\.\.|…)\]|\((?:more|\.\.\.)\)|<[a-zA-Z/]{0,4}|&[a-zA-Z]{1,5})\s*$"


def _units(text: str) -> str:
    plain = rf"regexp_replace(regexp_replace({text}, '{_MARK}', ''), '<[^<>]{{1,40}}>', chr(10), 'g')"
    kept = rf"regexp_replace(regexp_replace({plain}, '\b([Nn]o)\.(\s)', '\1' || chr(2) || '\2', 'g'), '/oz\.(\s)', '/oz' || chr(2) || '\1', 'g')"
    ends = rf"regexp_replace({kept}, '([.!?])\s+([^\p{{Ll}}\s])', '\1' || chr(1) || '\2', 'g')"
    fields = rf"regexp_replace({ends}, '\s*\n[\s-]*|\s+\|\s+|;\s+', chr(1), 'g')"
    return f"list_filter(string_split(replace({fields}, chr(2), '.'), chr(1)), lambda u: trim(u) <> '')"


def _normal(unit: str) -> str:
    digits = rf"translate(regexp_replace({unit}, '[.!?\s]+$', ''), '012345678', '999999999')"
    codes = rf"regexp_replace({digits}, '(^|[^\p{{L}}\p{{N}}])(?:[A-Z]{{3}}|[a-z]{{3}})([-/]?99)', '\1aaa\2', 'g')"
    numbers = rf"regexp_replace({codes}, '(^|[^\p{{L}}\p{{N}}])(?:9[9.,/½¼¾]*[9/½¼¾]|9|[½¼¾])', '\19', 'g')"
    return rf"trim(regexp_replace(lower({numbers}), '\s{{2,}}|[\t\x{{A0}}]', ' ', 'g'))"


_TRUNCATED = rf"""WITH every_row AS (SELECT rid, source, description FROM catalog_left UNION ALL SELECT rid, source, description FROM catalog_right UNION ALL SELECT rid, source, description FROM listings),
t AS (SELECT rid, coalesce(source, '') AS source, length(description) AS size, regexp_matches(right(description, 12), '{_MARK}') AS mark, {_units('description')} AS units FROM every_row WHERE trim(description) <> ''),
said AS (SELECT unnest(units) AS unit FROM t),
counted AS (SELECT {_normal('unit')} AS words, count(*) AS n FROM said GROUP BY 1),
split_words AS (SELECT list_concat(['<s>', '<s>'], string_split(words, ' ')) AS w, n FROM counted WHERE words <> ''),
grams AS (SELECT w[i] || ' ' || w[i + 1] AS head, w[i + 2] AS last, sum(CASE WHEN i + 2 < len(w) THEN n ELSE 0 END) AS n, sum(CASE WHEN i + 2 = len(w) THEN n ELSE 0 END) AS n_end FROM (SELECT w, n, unnest(range(1, len(w) - 1)) AS i FROM split_words) GROUP BY 1, 2),
tails AS (SELECT rid, source, size, mark, regexp_matches(coalesce(units[-1], ''), '(^|[^.])[.!?]\s*$') AS closed, list_concat(['<s>', '<s>'], string_split({_normal('units[-1]')}, ' ')) AS w FROM t),
ends AS (SELECT rid, source, size, mark, closed, w[-3] || ' ' || w[-2] AS head, w[-1] AS last FROM tails),
asked AS (SELECT DISTINCT head, last, closed FROM ends WHERE last <> ''),
rare AS (SELECT a.head, a.last, a.closed FROM asked a JOIN grams g ON a.head = g.head AND starts_with(g.last, a.last) GROUP BY ALL
  HAVING sum(CASE WHEN g.last = a.last THEN g.n_end ELSE 0 END) < CASE WHEN a.closed THEN 0.04 ELSE 0.08 END * sum(CASE WHEN g.last = a.last THEN g.n + g.n_end WHEN a.closed THEN 0 ELSE g.n + g.n_end END)),
judged AS (SELECT e.*, r.head IS NOT NULL AS cut FROM ends e LEFT JOIN rare r ON r.head = e.head AND r.last = e.last AND r.closed = e.closed),
shares AS (SELECT source, size, count(*) AS n, count(*) FILTER (cut) / count(*) AS p FROM judged GROUP BY 1, 2),
hits AS (SELECT source, size FROM shares WHERE p > 0 AND (p + 4.0 / (2 * n) - 2 * sqrt(p * (1 - p) / n + 4.0 / (4 * n * n))) / (1 + 4.0 / n) > 0.4),
signs AS (SELECT rid, j.source, cut OR mark OR h.size IS NOT NULL AS gone FROM judged j LEFT JOIN hits h ON h.source = j.source AND h.size = j.size)"""

ORACLES: dict[str, str] = {
    "p7_found": f"{_TRUNCATED} SELECT DISTINCT rid FROM signs WHERE gone",
    "p7_rates": f"""{_TRUNCATED} SELECT source, count(DISTINCT rid) AS n_texts, count(DISTINCT rid) FILTER (gone) AS n_cut, round(count(DISTINCT rid) FILTER (gone) / count(DISTINCT rid), 6) AS share FROM signs GROUP BY source""",
}
