"""DuckDB statements with the expected results of the registered queries."""

from __future__ import annotations

NOTICES = """notices AS (
  SELECT ['federal','nsw','vic','qld','sa','wa'][CAST(c_nationkey % 6 AS INTEGER) + 1] AS source,
         'CN' || l_orderkey AS contract_id,
         concat_ws('-', 'CN' || l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS release_id,
         'ocds-' || l_orderkey AS ocid,
         s_name || ' Pty Ltd' AS supplier,
         'Department of ' || c_mktsegment AS agency,
         p_name AS title,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         l_shipdate AS release_date,
         CAST(l_shipdate AS DATE) AS release_day,
         CAST(l_shipdate AS DATE) + CAST(floor(l_quantity) AS INTEGER) AS contract_end,
         CASE WHEN l_linenumber = 1 THEN 'contract' ELSE 'contractAmendment' END AS tag,
         CASE WHEN month(l_shipdate) >= 7 THEN year(l_shipdate) || '-' || lpad(CAST((year(l_shipdate) + 1) % 100 AS VARCHAR), 2, '0')
              ELSE (year(l_shipdate) - 1) || '-' || lpad(CAST(year(l_shipdate) % 100 AS VARCHAR), 2, '0') END AS fy,
         strftime(l_shipdate, '%Y-%m') AS month,
         regexp_replace(replace(lower('Department of ' || c_mktsegment), ' ', '_'), '[^a-z0-9_-]+', '', 'g') AS agency_key,
         regexp_replace(replace(lower(s_name || ' Pty Ltd'), ' ', '_'), '[^a-z0-9_-]+', '', 'g') AS company_key,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, c_custkey
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN part ON l_partkey = p_partkey)"""


def latest(rows: str, keys: str = "source, contract_id") -> str:
    return (
        f"SELECT * FROM {rows} QUALIFY row_number() OVER "
        f"(PARTITION BY {keys} ORDER BY release_date DESC, release_id, amount) = 1"
    )


def _total(where: str) -> str:
    return f"""WITH {NOTICES}, hits AS (SELECT * FROM notices WHERE {where}), best AS ({latest('hits')})
SELECT count(*) AS contracts, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_spend, count(*) > 0 AS matched FROM best"""


_WIDE = """contains(lower(concat_ws(' ', supplier, title, agency, contract_id)), 'widget')
  AND contains(lower(supplier), 'supplier#0000000') AND agency = 'Department of MACHINERY'
  AND release_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-06-30'"""
_FOUND = f"hits AS (SELECT * FROM notices WHERE {_WIDE}), best AS ({latest('hits')})"
_TOP = "SELECT * FROM best ORDER BY amount DESC, source, contract_id LIMIT {n}"
_RESULT = """contract_id, release_id, ocid, source, supplier, agency, title, CAST(amount AS DOUBLE) AS amount,
  fy AS financial_year, release_day AS release_date"""

# --- entity names: tokens as list functions --------------------------------------------------

_COMMON = "['the','of','and','for','to']"
_LEGAL = "['pty','ltd','limited','proprietary','inc','llc','plc','corp','corporation']"


def key(x: str) -> str:
    clean = f"regexp_replace(replace(lower(trim({x})), ' ', '_'), '[^a-z0-9_-]+', '', 'g')"
    return f"CASE WHEN {clean} = '' THEN 'unknown' ELSE {clean} END"


def raw_tokens(x: str) -> str:
    return f"regexp_extract_all(replace(replace(lower({x}), '&', ' and '), '@', ' at '), '[a-z0-9]+')"


def token_ctes(source: str, name: str, kinds: tuple[str, ...] = ("company", "agency")) -> str:
    """CTEs ending in ``tok`` with <kind>_tok lists and <kind>_id of every row of ``source``."""
    alias = (
        "CASE t WHEN 'dept' THEN 'department' WHEN 'depts' THEN 'department' WHEN 'govt' THEN 'government' "
        "WHEN 'svc' THEN 'services' WHEN 'svcs' THEN 'services' WHEN 'tech' THEN 'technology' ELSE t END"
    )
    legal = f"(len(raw) > 1 AND list_contains({_LEGAL}, t))"
    kept = {
        "company": f"NOT list_contains({_COMMON}, t) AND NOT {legal}",
        "agency": f"NOT list_contains({_COMMON}, t)",
    }
    first = ", ".join(
        f"list_filter(mapped, lambda t: {kept[k]}) AS {k}_kept" for k in kinds
    )
    second = ", ".join(
        f"CASE WHEN len({k}_kept) > 0 THEN {k}_kept WHEN len(raw) = 0 THEN [] ELSE "
        f"list_filter(regexp_split_to_array(skey, '[_-]+'), lambda t: t <> '') END AS {k}_dup" for k in kinds
    )
    third = ", ".join(
        f"list_filter({k}_dup, lambda t, i: list_position({k}_dup, t) = i) AS {k}_tok" for k in kinds
    )
    fourth = ", ".join(
        f"CASE WHEN len({k}_tok) = 0 THEN CASE WHEN skey = 'unknown' THEN '' ELSE skey END "
        f"ELSE array_to_string(list_sort({k}_tok), '_') END AS {k}_id" for k in kinds
    )
    value = f"replace(replace(lower({name}), '&', ' and '), '@', ' at ')"
    return f"""tok0 AS (SELECT *, {raw_tokens(name)} AS raw, {key(value)} AS skey FROM {source}),
tok1 AS (SELECT *, list_transform(raw, lambda t: {alias}) AS mapped FROM tok0),
tok2 AS (SELECT *, {first} FROM tok1),
tok3 AS (SELECT *, {second} FROM tok2),
tok4 AS (SELECT *, {third} FROM tok3),
tok AS (SELECT *, {fourth} FROM tok4)"""


_MESSY = """base AS (SELECT c_name AS b FROM customer UNION ALL SELECT s_name FROM supplier),
messy AS (SELECT unnest([b || ' Pty Ltd', '  The Dept. of ' || b || ' & Co.  LIMITED',
  'GOVT Svcs @ ' || upper(b) || '/Tech-Corp', 'Limited To For ' || regexp_replace(b, '[^#]', '', 'g')]) AS name FROM base)"""

_CATALOG = """catalog AS (SELECT source, fy, month, agency, agency_key, supplier, company_key, count(*) AS row_count
  FROM notices GROUP BY ALL)"""


def _find(name: str, pk: str, lower: str, query_key: str, tokens: str, identifier: str, kind: str, where: str, limit: int) -> str:
    return f"""WITH {NOTICES}, {_CATALOG},
ent AS (SELECT source, {name} AS name, {pk} AS pkey, sum(row_count) AS n FROM catalog WHERE {where} GROUP BY ALL),
{token_ctes('ent', 'name', (kind,))},
hit AS (SELECT *, len(list_filter({tokens}, lambda t: list_contains({kind}_tok, t))) AS shared,
    len({tokens}) AS wanted FROM tok),
sc AS (SELECT *, CASE WHEN {kind}_id = '{identifier}' THEN 1000 ELSE 0 END
    + CASE WHEN lower(name) = '{lower}' THEN 300 WHEN contains(lower(name), '{lower}') THEN 120 ELSE 0 END
    + CASE WHEN pkey = '{query_key}' THEN 180 WHEN contains(pkey, '{query_key}') THEN 80 ELSE 0 END
    + CASE WHEN shared = wanted THEN 200 + 10 * shared ELSE 5 * shared END AS score FROM hit
  WHERE {kind}_id = '{identifier}' OR contains(lower(name), '{lower}') OR contains(pkey, '{query_key}') OR shared = wanted)
SELECT source, min(name) AS name, min(pkey) AS key, CAST(sum(n) AS BIGINT) AS rows, CAST(max(score) AS INTEGER) AS score
FROM sc GROUP BY source, {kind}_id ORDER BY score DESC, rows DESC, name, source LIMIT {limit}"""


# Filters of the batch lookup with the spelling already undone: a company filter matches exactly
# the supplier it was written from, plus any supplier whose name contains the loose text (none).
_FILTERS = """filters AS (
  SELECT 'c' || s_suppkey AS filter_id, s_name || ' Pty Ltd' AS company,
         CASE WHEN s_acctbal > 5000 THEN 'Department of MACHINERY' END AS agency,
         CASE WHEN s_nationkey < 5 THEN 'vic' END AS source,
         DATE '1995-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS d1,
         DATE '1995-01-01' + CAST(s_suppkey % 900 AS INTEGER) + 1000 AS d2 FROM supplier
  UNION ALL
  SELECT DISTINCT 'a-' || c_mktsegment, NULL, 'Department of ' || c_mktsegment, 'qld', DATE '1997-07-01', DATE '1998-06-30'
  FROM customer)"""

_QUESTIONS = """q AS (
  SELECT s_suppkey AS question_id, s_suppkey % 6 AS style, s_name, replace(s_name, '#', ' ') AS spaced, coalesce(c_mktsegment, 'BUILDING') AS seg,
         CASE WHEN s_nationkey < 8 THEN 'nsw' END AS hint
  FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey),
stats AS (SELECT source, supplier, count(*) AS n FROM notices GROUP BY ALL),
-- style 4 is searched by keyword and has a supplier candidate in its source, style 5 has none
cand AS (SELECT DISTINCT question_id, s.source AS cs FROM q JOIN stats s ON s.supplier = q.s_name || ' Pty Ltd'
  WHERE style = 4 AND s.source = coalesce(hint, 'qld')),
f AS (SELECT q.question_id, style, spaced, s_name, seg,
    CASE WHEN style IN (0, 1, 3) THEN spaced WHEN style = 4 AND cs IS NOT NULL THEN s_name || ' Pty Ltd' END AS company,
    CASE style WHEN 0 THEN 'Department of ' || seg WHEN 1 THEN 'Dept of ' || seg WHEN 2 THEN 'Department of ' || seg END AS agency,
    CASE style WHEN 4 THEN s_name WHEN 5 THEN 'Gear' END AS keyword,
    coalesce(cs, hint, CASE WHEN style = 4 THEN 'qld' END) AS source
  FROM q LEFT JOIN cand USING (question_id))"""

SQL = {
    "spend_by_fy_agency_top20": f"""WITH {NOTICES}
SELECT fy AS financial_year, agency, CAST(sum(amount) AS DOUBLE) AS total_amount, count(*) AS records
FROM notices GROUP BY fy, agency ORDER BY sum(amount) DESC, fy, agency LIMIT 20""",
    "total_spend_filtered": _total(
        "supplier = 'Supplier#000000007 Pty Ltd' AND agency = 'Department of MACHINERY' AND source = 'vic' "
        "AND release_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-06-30'"
    ),
    "total_spend_default_source": _total("agency = 'Department of FURNITURE' AND source = 'federal'"),
    "total_spend_all_versions": f"""WITH {NOTICES}
SELECT count(*) AS rows, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_spend, count(*) > 0 AS matched
FROM notices WHERE agency = 'Department of BUILDING' AND source = 'nsw'""",
    "latest_contract_versions": f"""WITH {NOTICES}, best AS ({latest('notices')})
SELECT source, contract_id, release_id, supplier, agency, title, CAST(amount AS DOUBLE) AS amount,
  release_day AS release_date, tag FROM best""",
    "contract_version_flags": f"""WITH {NOTICES}, acc AS ({latest('notices', 'source, contract_id, release_date')})
SELECT source, contract_id, release_id, CAST(amount AS DOUBLE) AS amount, release_day AS release_date,
  row_number() OVER (PARTITION BY source, contract_id ORDER BY release_date) > 1 AS is_update FROM acc""",
    "search_contracts": f"WITH {NOTICES}, {_FOUND}, top AS ({_TOP.format(n=100)}) SELECT {_RESULT} FROM top",
    "search_all_rows": f"WITH {NOTICES}, {_FOUND} SELECT {_RESULT} FROM best",
    "replayed_load_totals": f"""WITH {NOTICES}
SELECT source, month, CAST(sum(amount) AS DOUBLE) AS total_amount, count(*) AS records FROM notices GROUP BY source, month""",
    "search_summary": f"""WITH {NOTICES}, {_FOUND}, top AS ({_TOP.format(n=25)})
SELECT (SELECT count(*) FROM top) AS count, (SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) FROM top) AS total_spend,
  (SELECT count(*) FROM best) AS count_all, (SELECT CAST(coalesce(sum(amount), 0) AS DOUBLE) FROM best) AS total_spend_all""",
    "search_sorted_by_title": f"""WITH {NOTICES}, {_FOUND}, top AS ({_TOP.format(n=60)})
SELECT {_RESULT} FROM top ORDER BY lower(title), source, contract_id LIMIT 25""",
    "search_export": f"""WITH {NOTICES}, {_FOUND}, top AS ({_TOP.format(n=40)})
SELECT supplier AS "Supplier", agency AS "Agency", title AS "Title", CAST(amount AS DOUBLE) AS "Amount",
  release_day AS "Date", source AS "Source", contract_id AS "ContractID", ocid AS "OCID" FROM top""",
    "portal_notice_filter": f"""WITH {NOTICES}
SELECT source, release_id, supplier, title, CAST(amount AS DOUBLE) AS amount, release_day AS release_date, contract_end
FROM notices WHERE contains(lower(contract_id || ' ' || title || ' ' || supplier || ' ' || agency), 'ring')
  AND contains(lower(supplier), 'supplier#0000000') AND contains(lower(agency), 'building')
  AND release_day >= DATE '1996-01-01' AND NOT (release_day > DATE '1999-12-31' AND contract_end > DATE '1999-12-31')""",
    "monthly_spend": f"""WITH {NOTICES}
SELECT source, month, CAST(sum(amount) AS DOUBLE) AS total_amount, count(*) AS records FROM notices GROUP BY source, month""",
    "incremental_union_total": f"""WITH {NOTICES}, best AS ({latest('notices')})
SELECT source, count(*) AS contracts, CAST(sum(amount) AS DOUBLE) AS total_spend FROM best GROUP BY source""",
    "dedupe_composite": f"""WITH {NOTICES}, one AS (SELECT DISTINCT source, contract_id, release_day, amount FROM notices)
SELECT source, count(*) AS records, CAST(sum(amount) AS DOUBLE) AS total_amount FROM one GROUP BY source""",
    "first_listed_contracts": f"""WITH {NOTICES}
SELECT source, contract_id, release_id, title, CAST(amount AS DOUBLE) AS amount FROM notices
QUALIFY row_number() OVER (PARTITION BY source, contract_id ORDER BY title, release_id, amount) = 1""",
    "entity_tokens_identifier": f"""WITH {_MESSY}, {token_ctes('messy', 'name')}
SELECT name, array_to_string(company_tok, ' ') AS company_tokens, company_id,
  array_to_string(agency_tok, ' ') AS agency_tokens, agency_id FROM tok""",
    "sanitize_partition_keys": f"""WITH {_MESSY}, t AS (SELECT text FROM conversations UNION ALL SELECT name FROM messy)
SELECT text, {key("regexp_replace(text, '^[[:space:]]+|[[:space:]]+$', '', 'g')")} AS key FROM t""",
    "entity_catalog": f"WITH {NOTICES}, {_CATALOG} SELECT * FROM catalog",
    "find_agencies": _find(
        "agency", "agency_key", "dept of furniture", "dept_of_furniture", "['department','furniture']",
        "department_furniture", "agency", "true", 10,
    ),
    "find_companies": _find(
        "supplier", "company_key", "the supplier 000000001 limited", "the_supplier_000000001_limited",
        "['supplier','000000001']", "000000001_supplier", "company", "source = 'nsw'", 20,
    ),
    "find_companies_top": f"""WITH {NOTICES}
SELECT source, supplier AS name, company_key AS key, count(*) AS rows, CAST(0 AS INTEGER) AS score
FROM notices GROUP BY ALL ORDER BY rows DESC, name, source LIMIT 50""",
    "resolve_entities_batch": f"""WITH {NOTICES}, stats AS (SELECT source, supplier, count(*) AS n FROM notices GROUP BY ALL)
SELECT s_suppkey AS query_id, s_name || ' Pty Ltd' AS name, arg_min(source, struct_pack(a := -n, b := source)) AS source
FROM supplier JOIN stats ON stats.supplier = s_name || ' Pty Ltd' GROUP BY ALL""",
    "batch_spend_lookup": f"""WITH {NOTICES}, {_FILTERS},
hits AS (SELECT filter_id, n.source, n.contract_id, n.release_id, n.amount, n.release_date FROM filters f JOIN notices n ON
  (f.company IS NULL OR n.supplier = f.company) AND (f.agency IS NULL OR n.agency = f.agency)
  AND (f.source IS NULL OR n.source = f.source) AND n.release_day BETWEEN d1 AND d2),
best AS ({latest('hits', 'filter_id, source, contract_id')})
SELECT filter_id, count(contract_id) AS contracts, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_spend
FROM filters LEFT JOIN best USING (filter_id) GROUP BY filter_id""",
    "keyword_spend_lookup": f"""WITH {NOTICES},
words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
hits AS (SELECT w, n.source, n.contract_id, n.release_id, n.amount, n.release_date FROM words JOIN notices n
  ON contains(lower(concat_ws(' ', supplier, title, agency, contract_id)), lower(w))),
best AS ({latest('hits', 'w, source, contract_id')})
SELECT 'k-' || w AS filter_id, count(contract_id) AS contracts, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_spend
FROM words LEFT JOIN best USING (w) GROUP BY w""",
    "entity_semi_join_spend": f"""WITH {NOTICES}
SELECT source, fy, CAST(sum(amount) AS DOUBLE) AS total_amount, count(*) AS records FROM notices
WHERE contains(lower(supplier), 'supplier#0000000') AND agency = 'Department of MACHINERY'
  AND release_day BETWEEN DATE '1996-07-01' AND DATE '2001-06-30' GROUP BY source, fy""",
    "answer_spend_questions": f"""WITH {NOTICES}, {_QUESTIONS},
hits AS (SELECT f.question_id, n.source, n.contract_id, n.release_id, n.amount, n.release_date FROM f JOIN notices n ON
  (style IN (2, 5) OR n.supplier = s_name || ' Pty Ltd') AND (style > 2 OR n.agency = 'Department of ' || seg)
  AND (f.source IS NULL OR n.source = f.source)
  AND (keyword IS NULL OR contains(lower(concat_ws(' ', n.supplier, n.title, n.agency, n.contract_id)), lower(keyword)))),
best AS ({latest('hits', 'question_id, source, contract_id')}),
sums AS (SELECT question_id, count(contract_id) AS contracts, coalesce(sum(amount), 0) AS total
  FROM f LEFT JOIN best USING (question_id) GROUP BY question_id)
SELECT question_id, company, agency, keyword, f.source, contracts, CAST(total AS DOUBLE) AS total_spend,
  'Total spend ' || CASE WHEN coalesce(company, CASE WHEN agency IS NULL THEN keyword END) IS NOT NULL
      THEN 'on ' || coalesce(company, keyword) || coalesce(' by ' || agency, '') ELSE 'by ' || agency END
    || coalesce(' (' || upper(f.source) || ')', '') || ' over the past 20 years: $' || format('{{:,.2f}}', CAST(total AS DOUBLE)) AS answer
FROM f JOIN sums USING (question_id)""",
}

# --- calendar, coverage and saved results -----------------------------------------------------

_REQUESTS = """requests AS (
  SELECT c_custkey AS request_id, ['federal','nsw','vic','qld','sa','wa'][CAST(c_nationkey % 6 AS INTEGER) + 1] AS source,
         min(CAST(o_orderdate AS DATE)) AS d1, max(CAST(o_orderdate AS DATE)) AS d2
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
_MONTHS = """windows AS (
  SELECT request_id, source, CAST(greatest(m, d1) AS DATE) AS window_start, CAST(least(last_day(m), d2) AS DATE) AS window_end,
         strftime(m, '%Y-%m') AS month
  FROM (SELECT *, CAST(unnest(generate_series(date_trunc('month', d1), CAST(d2 AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM requests))"""
_LOADS = """monthly AS (SELECT source, month, count(*) AS n FROM notices GROUP BY ALL),
loads AS (SELECT source, month FROM monthly QUALIFY n * count(*) OVER (PARTITION BY source) >= sum(n) OVER (PARTITION BY source))"""

_LAYOUT_OK = {
    "iso": "sa wa qld catalogue", "slash": "sa wa qld", "slash_short": "", "dash_month": "nsw sa qld",
    "dash_month_short_year": "nsw", "space_month": "vic sa qld", "long_month": "vic sa", "month_first": "qld",
    "rfc3339": "qld catalogue ocds", "midnight": "qld", "serial": "qld", "junk": "",
}
_PARSERS = "nsw vic sa wa qld catalogue ocds".split()


def _layout_counts() -> str:
    """Which parser reads which layout, as counts of rows; short spellings depend on the day."""
    one_digit = "month(release_date) < 10"
    special = {
        # two-digit months are required except in one jurisdiction, day and month digits in another
        ("slash_short", "sa"): "true",
        ("slash_short", "qld"): f"NOT ({one_digit})",
        ("slash_short", "wa"): f"NOT ({one_digit}) AND day(release_date) >= 10",
        # May has the same short and long name
        ("long_month", "qld"): "month(release_date) = 5",
    }
    parts = []
    for layout, ok in _LAYOUT_OK.items():
        cols = []
        for parser in _PARSERS:
            test = special.get((layout, parser), "true" if parser in ok.split() else "false")
            cols.append(f"count(*) FILTER (WHERE {test}) AS {parser}")
        parts.append(f"SELECT '{layout}' AS layout, count(*) AS rows, {', '.join(cols)}, CAST(0 AS BIGINT) AS wrong FROM notices")
    return " UNION ALL ".join(parts)


_SPELLED = """names AS (SELECT * FROM (VALUES (0,'Federal','federal'), (1,'Commonwealth','federal'), (2,'AusTender','federal'),
  (3,'Australian  Government','federal'), (4,'federal_government','federal'), (5,'QLD','qld'), (6,'Queensland','qld'),
  (7,'qld-government','qld'), (8,'Queensland Government.','qld'), (9,'nsw','nsw'), (10,'New South Wales','nsw'),
  (11,'NSW/Government','nsw'), (12,'VIC','vic'), (13,'victoria','vic'), (14,'Victorian Government','vic'), (15,'SA','sa'),
  (16,'South Australia','sa'), (17,'sa government','sa'), (18,'WA','wa'), (19,'Western Australia','wa'),
  (20,'W.A. Government','w a government'), (21,'western australian government','wa'), (22,'Tasmania','tasmania'),
  (23,'Northern-Territory','northern territory'), (24,'  ','federal')) v(i, spelled, canon))"""
_PHRASES = [
    ("western australian government", "wa"), ("western australia", "wa"), ("queensland government", "qld"),
    ("queensland", "qld"), ("south australian government", "sa"), ("south australia", "sa"),
    ("victorian government", "vic"), ("victoria", "vic"), ("new south wales", "nsw"), ("nsw government", "nsw"),
    ("australian government", "federal"), ("federal government", "federal"), ("commonwealth", "federal"),
    ("austender", "federal"),
]
_PHRASE = "CASE " + " ".join(f"WHEN contains(l, '{p}') THEN '{p}'" for p, _ in _PHRASES) + " END"
_PHRASE_SOURCE = "CASE phrase " + " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in _PHRASES) + " END"

_RUNS = """runs AS (SELECT ts, 'user ' || user_id AS company, event_type AS keyword,
    (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Sydney' AS local_ts FROM events)"""

# --- sources ----------------------------------------------------------------------------------

# What a release page of each line item should turn into.
_RELEASED = """released AS (SELECT *,
    CASE WHEN floor(l_quantity) = 2 THEN 'error page' WHEN floor(l_quantity) = 1 THEN 'not a contract release' END AS bad
  FROM notices)"""
_SHOW = "supplier, agency, title, CAST(amount AS DOUBLE) AS amount, release_day AS release_date"
_PORTAL = "SELECT * REPLACE ('{0}' AS source), '' AS empty FROM notices"

SQL |= {
    "month_windows": f"WITH {_REQUESTS}, {_MONTHS} SELECT request_id, source, window_start, window_end, month FROM windows",
    "day31_windows": f"""WITH {_REQUESTS}, days AS (
  SELECT *, unnest(generate_series(0, greatest(d2 - d1 - 1, 0), 31)) AS n FROM requests)
SELECT request_id, source, CAST(d1 + CAST(n AS INTEGER) AS DATE) AS window_start,
  CAST(least(d1 + CAST(n AS INTEGER) + 31, d2) AS DATE) AS window_end, strftime(d1 + CAST(n AS INTEGER), '%Y-%m') AS month FROM days""",
    "month_coverage": f"WITH {NOTICES}, {_LOADS} SELECT source, month FROM loads",
    "uncovered_months": f"""WITH {NOTICES}, {_LOADS}, {_REQUESTS}, {_MONTHS}
SELECT request_id, source, month, window_start, window_end FROM windows w
WHERE NOT EXISTS (SELECT 1 FROM loads l WHERE l.source = w.source AND l.month = w.month)""",
    "coverage_complete": f"""WITH {NOTICES}, {_LOADS}, {_REQUESTS}, {_MONTHS}
SELECT request_id, count(*) AS windows, count(*) - count(l.month) AS missing, count(*) = count(l.month) AS complete
FROM windows w LEFT JOIN loads l ON l.source = w.source AND l.month = w.month GROUP BY request_id""",
    "window_range_join": f"""WITH {NOTICES}, {_LOADS}, span AS (
  SELECT source, min(release_day) + 10 AS d1, max(release_day) - 10 AS d2 FROM notices GROUP BY source)
SELECT n.source, n.month, count(*) AS records, CAST(sum(amount) AS DOUBLE) AS total_amount
FROM notices n JOIN span s ON n.source = s.source AND release_day BETWEEN d1 AND d2
WHERE NOT EXISTS (SELECT 1 FROM loads l WHERE l.source = n.source AND l.month = n.month) GROUP BY n.source, n.month""",
    "load_jobs_by_supplier": """SELECT s_suppkey, s_name AS supplier, CAST(a AS DATE) AS window_start, CAST(b AS DATE) AS window_end, m AS month
FROM supplier, (VALUES ('1999-11-15','1999-11-30','1999-11'), ('1999-12-01','1999-12-31','1999-12'), ('2000-01-01','2000-01-31','2000-01'),
  ('2000-02-01','2000-02-29','2000-02'), ('2000-03-01','2000-03-02','2000-03')) w(a, b, m)
WHERE contains(lower(s_name), 'supplier#0000000')""",
    "resolved_ranges": f"""WITH {_REQUESTS}, r AS (SELECT request_id, c_acctbal AS bal, d1, d2,
    CASE WHEN bal < 2000 THEN 3 ELSE 20 END AS years FROM requests JOIN customer ON c_custkey = request_id),
ends AS (SELECT *, CASE WHEN bal >= 9000 THEN d2 WHEN bal >= 0 THEN d1 END AS a,
    CASE WHEN bal >= 9000 THEN d1 WHEN bal < 5000 THEN d2 ELSE DATE '2002-01-01' END AS b FROM r),
filled AS (SELECT request_id, b, CASE WHEN a IS NOT NULL THEN a WHEN month(b) = 2 AND day(b) = 29
    AND day(last_day(b - to_years(years))) = 28 THEN CAST(make_date(year(b) - years, 3, 1) AS DATE)
    ELSE CAST(b - to_years(years) AS DATE) END AS a FROM ends)
SELECT request_id, least(a, b) AS start, greatest(a, b) AS "end" FROM filled""",
    "user_dates": """WITH o AS (SELECT o_orderkey, o_orderdate AS d, left(o_orderpriority, 1) AS p FROM orders)
SELECT o_orderkey, CASE p WHEN '1' THEN strftime(d, '%Y-%m-%d') WHEN '2' THEN strftime(d, '%Y-%m-%dT%H:%M:%SZ')
    WHEN '3' THEN strftime(d, '%Y-%m-%dT%H:%M:%S+10:00') WHEN '4' THEN strftime(d, '%d/%m/%Y') ELSE '  ' END AS raw,
  CASE WHEN p IN ('1', '2') THEN CAST(epoch(d) AS BIGINT) WHEN p = '3' THEN CAST(epoch(d) AS BIGINT) - 36000 END AS epoch,
  p = '4' AS is_bad FROM o""",
    "date_parse_multi": f"WITH {NOTICES} {_layout_counts()}",
    "money_parse_format": f"""WITH {NOTICES}, t AS (SELECT sum(amount) AS s, count(*) AS n, max('$' || format('{{:,.2f}}', CAST(amount AS DOUBLE))) AS top,
    max('-$' || format('{{:,.2f}}', CAST(amount AS DOUBLE))) AS low FROM notices)
SELECT 'plain' AS spelling, n AS lenient_rows, CAST(s AS DOUBLE) AS lenient_sum, CAST(s AS DOUBLE) AS zero_sum, n AS strict_rows, CAST(s AS DOUBLE) AS strict_sum, top AS top_shown FROM t
UNION ALL SELECT 'dollars', n, s, s, n, s, top FROM t
UNION ALL SELECT 'prefixed', n, s, s, 0, NULL, top FROM t
UNION ALL SELECT 'negative', n, -s, -s, n, -s, low FROM t
UNION ALL SELECT 'blank', n, 0, 0, n, 0, '$0.00' FROM t
UNION ALL SELECT 'words', 0, NULL, 0, 0, NULL, NULL FROM t""",
    "canonical_sources": f"""WITH {_SPELLED}
SELECT c_custkey, spelled AS text, canon AS source FROM customer JOIN names ON i = c_custkey % 25""",
    "detect_jurisdiction": f"""WITH {_SPELLED}, texts AS (
  SELECT conv_id, turn, lower(text || ' - spend in ' || spelled) AS l FROM conversations JOIN names ON i = (conv_id + turn) % 25),
p AS (SELECT *, {_PHRASE} AS phrase, regexp_extract(' ' || regexp_replace(l, '[^a-z0-9]+', ' ', 'g') || ' ',
    ' (federal|commonwealth|austender|qld|queensland|nsw|vic|victoria|sa|wa) ', 1) AS token FROM texts)
SELECT conv_id, turn, CASE WHEN phrase IS NOT NULL THEN {_PHRASE_SOURCE} WHEN token IN ('commonwealth','austender') THEN 'federal'
    WHEN token = 'queensland' THEN 'qld' WHEN token = 'victoria' THEN 'vic' ELSE nullif(token, '') END AS source,
  CASE WHEN phrase IS NOT NULL THEN 'phrase matched: ' || phrase WHEN token <> '' THEN 'token matched: ' || token ELSE 'no match' END AS evidence FROM p""",
    "supplier_search_terms": """WITH k AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders),
p AS (SELECT *, lpad(k, 11, '2') AS e, lpad(k, 9, '1') AS n FROM k)
SELECT o_orderkey, left(e, 2) || ' ' || substr(e, 3, 3) || ' ' || substr(e, 6, 3) || ' ' || right(e, 3) AS term, 'abn' AS kind, e AS value FROM p
UNION ALL SELECT o_orderkey, n, 'acn', n FROM p
UNION ALL SELECT o_orderkey, k, CASE length(k) WHEN 11 THEN 'abn' WHEN 9 THEN 'acn' ELSE 'name' END, k FROM p
UNION ALL SELECT o_orderkey, ' Order ' || k, 'name', 'Order ' || k FROM p""",
    "daily_snapshots": f"""WITH {_RUNS}, d AS (SELECT *, CAST(local_ts AS DATE) AS day FROM runs)
SELECT day AS snapshot_day, 'day=' || day || '|company=' || company || '|agency=|keyword=' || keyword || '|source=federal|dateType=|lookback=20|start=|end=' AS query_key,
  count(*) AS runs, min(epoch_us(ts)) AS first_run,
  max(CAST(epoch(CAST(day + 1 AS TIMESTAMP) AT TIME ZONE 'Australia/Sydney') AS BIGINT)) AS expires
FROM d GROUP BY day, company, keyword""",
    "run_checkpoints": f"""WITH {_RUNS}, c AS (SELECT company || '|' || keyword AS query_key, max(ts) AS m FROM runs GROUP BY ALL)
SELECT query_key, epoch_us(m) AS checkpoint,
  epoch_us(CASE WHEN m > TIMESTAMP '2024-01-01' AND m < TIMESTAMP '2024-01-20' THEN m ELSE TIMESTAMP '2024-01-01' END) AS search_start FROM c""",
    "ocds_notices": f"""WITH {NOTICES}, {_RELEASED}
SELECT contract_id, {_SHOW}, source, release_id, ocid, tag, fy, month FROM released WHERE bad IS NULL""",
    "ocds_rejects": f"""WITH {NOTICES}, {_RELEASED}
SELECT source, CASE bad WHEN 'error page' THEN 'error 500: upstream' ELSE bad END AS reason, count(*) AS rows
FROM released WHERE bad IS NOT NULL GROUP BY ALL""",
    "ocds_filtered_total": f"""WITH {NOTICES}, {_RELEASED},
hits AS (SELECT * FROM released WHERE bad IS NULL AND contains(lower(supplier), 'supplier#0000000') AND agency = 'Department of MACHINERY'),
best AS ({latest('hits')})
SELECT source, count(*) AS contracts, CAST(sum(amount) AS DOUBLE) AS total_spend FROM best GROUP BY source""",
    "catalogue_resources": """WITH p AS (SELECT *, CAST(DATE '2024-01-01' + CAST(p_size AS INTEGER) AS TIMESTAMP) AS d FROM part)
SELECT 'res-' || p_partkey || 'a' AS resource_id, 'https://data.example.test/' || p_partkey || '.csv' AS url, 'csv' AS format,
  p_name AS dataset_title, p_brand AS organization, CAST(epoch(d) AS BIGINT) + 37800 AS modified FROM p
UNION ALL SELECT 'res-' || p_partkey || 'b', 'http://files.example.test/' || p_partkey, 'xlsx', p_name, p_brand,
  CAST(epoch(TIMESTAMP '2023-05-06 07:08:09') AS BIGINT) FROM p""",
    "stale_resources": """SELECT 'res-' || p_partkey || 'a' AS resource_id, 'csv' AS format FROM part WHERE p_size >= 15
UNION ALL SELECT 'res-' || p_partkey || 'b', 'xlsx' FROM part""",
    "csv_header_mapping": f"""WITH {NOTICES}, f AS (SELECT *, l_linenumber % 3 AS layout,
    'fy-' || fy || '-' || (l_linenumber % 3) || '.csv' AS raw_file FROM notices)
SELECT CASE WHEN layout < 2 THEN contract_id ELSE '| ' || supplier || ' | ' || title END AS contract_id, supplier,
  CASE layout WHEN 0 THEN agency ELSE 'Department of Works' END AS agency,
  title, CAST(amount AS DOUBLE) AS amount, release_day AS release_date,
  raw_file || '#' || (l_orderkey * 8 + l_linenumber + 30) AS release_id, raw_file, month FROM f""",
    "portal_nsw_notices": f"""WITH {NOTICES}, p AS ({_PORTAL.format('nsw')})
SELECT CASE WHEN amount > 50000 THEN contract_id ELSE release_id END AS contract_id, {_SHOW}, source, release_id, contract_end FROM p""",
    "portal_vic_notices": f"""WITH {NOTICES}, p AS ({_PORTAL.format('vic')})
SELECT contract_id, supplier, agency, title || ' (Current)' AS title, CAST(amount AS DOUBLE) AS amount,
  release_day AS release_date, source, contract_id AS release_id, contract_end FROM p WHERE length(contract_id) >= 4""",
    "portal_sa_notices": f"""WITH {NOTICES}, p AS ({_PORTAL.format('sa')})
SELECT contract_id, {_SHOW}, source, contract_id AS release_id, CAST(NULL AS DATE) AS contract_end FROM p""",
    "portal_wa_notices": f"""WITH {NOTICES}, p AS ({_PORTAL.format('wa')})
SELECT contract_id, CASE WHEN amount > 40000 THEN supplier || ', Joint Co' ELSE 'Various' END AS supplier, agency, title,
  CAST(amount AS DOUBLE) AS amount, release_day AS release_date, source, contract_id AS release_id, CAST(NULL AS DATE) AS contract_end FROM p""",
    "all_sources_total": f"""WITH {NOTICES}, {_RELEASED},
federal AS (SELECT amount FROM released WHERE bad IS NULL),
qld AS (SELECT DISTINCT CASE WHEN l_linenumber % 3 < 2 THEN contract_id ELSE '| ' || supplier || ' | ' || title END AS c,
    release_day, amount FROM notices),
listed AS (SELECT source, amount FROM (SELECT *, CASE WHEN source = 'nsw' AND amount <= 50000 THEN release_id ELSE contract_id END AS c
    FROM notices WHERE source IN ('nsw', 'vic', 'sa', 'wa') AND (source <> 'vic' OR length(contract_id) >= 4))
  QUALIFY row_number() OVER (PARTITION BY source, c ORDER BY release_id, amount) = 1),
every AS (SELECT 'federal' AS source, amount FROM federal UNION ALL SELECT 'qld', amount FROM qld UNION ALL SELECT source, amount FROM listed)
SELECT source, count(*) AS records, CAST(sum(amount) AS DOUBLE) AS total_amount FROM every GROUP BY source""",
    "page_links": """WITH l AS (SELECT url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
    unnest(CASE WHEN html LIKE '%<a href="/%' THEN regexp_extract_all(html, '<a href="(/[^"]*)"', 1) ELSE [NULL] END) AS href FROM pages)
SELECT url, count(href) AS links, max(origin || href) AS last_link FROM l GROUP BY url""",
    "challenge_pages": """SELECT page_id, length(html) % 7 IN (0, 1) AS blocked FROM pages""",
    "page_link_ids": """WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT page_id, path, origin, unnest([0, 1, 2, 3, 4]) AS n FROM u),
r AS (SELECT page_id, n, path, CASE n WHEN 0 THEN origin || '/contract/view?id=1' WHEN 1 THEN 'https://other.example.test/notices/'
    WHEN 2 THEN regexp_extract(origin, '^https?:', 0) || '//cdn.example.test/a/b#c' WHEN 3 THEN origin || path || '?page=3'
    ELSE origin || CASE WHEN regexp_matches(path, '^/[^/]+/[^/]+/$') THEN regexp_extract(path, '^/[^/]+', 0) ELSE '' END || '/up/x.html' END AS link FROM l)
SELECT page_id, CAST(n AS INTEGER) AS n, link, nullif(regexp_extract(path, '([^/]*)/*$', 1), '') AS page_notice,
  CASE n WHEN 0 THEN 'view' WHEN 2 THEN 'b' WHEN 3 THEN nullif(regexp_extract(path, '([^/]*)/*$', 1), '') WHEN 4 THEN 'x.html' END AS link_notice FROM r""",
    "lake_roundtrip_pruned": f"""WITH {NOTICES}
SELECT release_id, supplier, agency, CAST(amount AS DOUBLE) AS amount, fy, month FROM notices
WHERE contains(lower(supplier), 'supplier#0000000') AND agency = 'Department of MACHINERY' AND source = 'qld'
  AND release_day BETWEEN DATE '1997-08-01' AND DATE '1998-03-31'""",
    "lake_month_reload": f"""WITH {NOTICES}
SELECT fy, CAST(sum(CASE WHEN fy = '1997-98' THEN 2 * amount ELSE amount END) AS DOUBLE) AS total_amount, count(*) AS records FROM notices GROUP BY fy""",
    "lake_sql": f"""WITH {NOTICES}
SELECT source, agency, CAST(sum(amount) AS DOUBLE) AS total_amount, count(*) AS records FROM notices WHERE fy >= '1998-99' GROUP BY source, agency""",
    "lake_catalog_lookup": _find(
        "supplier", "company_key", "supplier 000000003", "supplier_000000003", "['supplier','000000003']",
        "000000003_supplier", "company", "true", 10,
    ),
    "lake_file_rows": f"WITH {NOTICES} SELECT source, fy, month, count(*) AS records FROM notices GROUP BY ALL",
    "stream_dedupe_window": """SELECT CAST(time_bucket(INTERVAL 31 DAY, ts, TIMESTAMP '1970-01-01') AS DATE) AS window_start,
  CAST(time_bucket(INTERVAL 31 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 31 DAY AS DATE) AS window_end, event_type,
  count(*) AS records, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL""",
    "stream_latest_version": f"""WITH {NOTICES}, best AS ({latest('notices')}),
old AS (SELECT source, contract_id, min(release_date) AS first_date FROM notices GROUP BY ALL)
SELECT source, contract_id, release_id, CAST(amount AS DOUBLE) AS amount, release_day AS release_date,
  release_date > first_date AS is_update FROM best JOIN old USING (source, contract_id)""",
}

SQL["stream_load_resume"] = SQL["ocds_notices"]
SQL["stream_late_amendment"] = SQL["stream_latest_version"]
SQL["stream_update_events"] = f"""WITH {NOTICES},
e AS (SELECT source, contract_id, release_id, amount, release_date, release_day, CAST((9 - l_linenumber) % 3 AS BIGINT) AS batch FROM notices),
p AS (SELECT *, max(release_date) OVER (PARTITION BY source, contract_id ORDER BY batch
  RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e),
a AS (SELECT * FROM p WHERE newest IS NULL OR release_date > newest
  QUALIFY row_number() OVER (PARTITION BY source, contract_id, batch, release_date ORDER BY release_id, amount) = 1)
SELECT source, contract_id, release_id, CAST(amount AS DOUBLE) AS amount, row_number() OVER turn > 1 AS is_update,
  lag(release_id) OVER turn AS replaced_release, CAST(lag(amount) OVER turn AS DOUBLE) AS replaced_amount, release_day AS release_date, batch
FROM a WINDOW turn AS (PARTITION BY source, contract_id ORDER BY batch, release_date)"""
SQL["lake_file_pruned"] = f"""WITH {NOTICES}
SELECT release_id, supplier, agency, CAST(amount AS DOUBLE) AS amount, fy, month FROM notices
WHERE contains(lower(supplier), 'supplier#00000000') AND agency = 'Department of MACHINERY' AND source = 'qld'
  AND release_day BETWEEN DATE '1997-08-01' AND DATE '1999-12-31'"""
SQL["csv_file_scan"] = f"""WITH {NOTICES}
SELECT contract_id, supplier, agency,
  title || CASE WHEN l_linenumber % 2 = 0 THEN chr(10) || 'second "line";' || chr(9) || 'and, more' ELSE '' END AS title,
  CAST(amount AS DOUBLE) AS amount, release_day AS release_date, month FROM notices"""
SQL["portal_rejects"] = f"""WITH {NOTICES},
p AS (SELECT contract_id, unnest(['nsw', 'vic', 'sa', 'wa']) AS source, unnest(['search?n=', 'list/', 'search?p=', 'wa?n=']) AS folder, release_id FROM notices),
u AS (SELECT *, length('https://portal.example.test/' || folder || release_id) % 7 = 0 AS blocked FROM p)
SELECT source, 'challenge page' AS reason, count(*) AS rows FROM u WHERE blocked GROUP BY source
UNION ALL SELECT 'vic', 'unlikely contract id', count(*) + count(*) FILTER (WHERE length(contract_id) < 4) FROM u WHERE NOT blocked AND source = 'vic'
UNION ALL SELECT 'sa', 'no contract id', count(*) FROM u WHERE NOT blocked AND source = 'sa'"""
SQL["coverage_gaps"] = f"""WITH {NOTICES}, {_REQUESTS},
loads AS (SELECT source, contract_id, min(release_day) AS d FROM notices GROUP BY ALL HAVING count(*) = 7),
loaded AS (SELECT DISTINCT source, d + CAST(unnest(range(7)) AS INTEGER) AS day FROM loads),
need AS (SELECT request_id, source, CAST(unnest(generate_series(d1, d2, INTERVAL 1 DAY)) AS DATE) AS day FROM requests),
missing AS (SELECT * FROM need ANTI JOIN loaded USING (source, day)),
islands AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY request_id ORDER BY day) AS INTEGER) AS island FROM missing)
SELECT request_id, source, min(day) AS gap_start, max(day) AS gap_end FROM islands GROUP BY request_id, source, island"""
SQL["manifest_changes"] = """SELECT CAST(page_id AS VARCHAR) AS path,
  CASE length(html) % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'same' END AS change FROM pages
UNION ALL SELECT 'gone-' || page_id, 'gone' FROM pages WHERE length(html) % 5 = 2"""
SQL["ordered_notices"] = f"""WITH {NOTICES}
SELECT row_number() OVER (ORDER BY release_date, contract_id, release_id, source, amount) AS position, contract_id, release_id,
  release_day AS release_date FROM notices"""
SQL["load_progress"] = f"""WITH {NOTICES}, {_RELEASED}
SELECT count(*) AS read, count(*) FILTER (WHERE bad IS NULL) AS accepted, count(*) FILTER (WHERE bad IS NOT NULL) AS rejected,
  CAST(0 AS BIGINT) AS undated FROM released WHERE bad IS DISTINCT FROM 'error page'"""
SQL["daily_snapshot_reuse"] = f"""WITH {NOTICES}, asked AS (SELECT DISTINCT lower(c_mktsegment) AS a FROM customer),
hits AS (SELECT a, notices.* FROM asked JOIN notices ON contains(lower(agency), a)
  WHERE source = 'qld' AND release_day BETWEEN DATE '1997-07-01' AND DATE '1998-06-30'),
best AS ({latest('hits', 'a, source, contract_id')})
SELECT DATE '2024-03-01' AS snapshot_day,
  'day=2024-03-01|company=|agency=' || a || '|keyword=|source=qld|dateType=|lookback=|start=1997-07-01|end=1998-06-30' AS query_key,
  count(contract_id) AS contracts, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_spend,
  CAST(CASE WHEN a < 'g' THEN 0 ELSE 1 END AS BIGINT) AS run, CAST(0 AS BIGINT) AS computed_by_last_run
FROM asked LEFT JOIN best USING (a) GROUP BY a"""
