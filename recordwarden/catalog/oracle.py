"""The registered queries as plain SQL, written independently of the operators.

Duplicates use window functions, score gains are rescored once per check, and
rounding is done on 128-bit integers.
"""

from __future__ import annotations


def _round(x: str, digits: int) -> str:
    """Half-even rounding of the binary value of a non-negative double."""
    unit = "4503599627370496::HUGEINT"
    scaled = f"(CAST(({x}) * 4503599627370496.0::DOUBLE AS HUGEINT) * {10 ** digits})"
    whole, rest = f"({scaled} // {unit})", f"({scaled} % {unit})"
    half = "2251799813685248::HUGEINT"
    up = f"CASE WHEN {rest} > {half} OR ({rest} = {half} AND {whole} % 2 = 1) THEN 1 ELSE 0 END"
    return f"(CAST({whole} + {up} AS DOUBLE) / {10 ** digits}.0::DOUBLE)"


_OWNER = """CASE WHEN {k} % {gap} = 0 THEN NULL WHEN {k} % 13 = 0 THEN '  ada   NOVAK '
    ELSE ['Ada Novak', 'Ben Okafor', 'Chloe Ruiz', 'Dmitri Sato', 'Elif Kaya'][{k} % 5 + 1] END"""
_COUNTRY = """['U.S.A.', 'united states', 'Canada', ' Mexico ', 'Brasil', 'Argentina', 'chile', 'Peru',
    'UK', 'Great Britain', 'Deutschland', 'France', 'España', 'The Netherlands', 'Czech Republic',
    'Russia', 'Kenya', 'UAE', 'Japan', 'India', 'Republic of Korea', 'australia', 'Singapore',
    'Atlantis', 'new  zealand'][{k} + 1]"""

_TABLES = f"""
as_of AS (SELECT max(o_orderdate) AS d FROM orders),
contact_export AS (
  SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_name AS last_name,
    CASE c_custkey % 20 WHEN 0 THEN NULL WHEN 1 THEN 'info@shop' || (c_custkey % 50) || '.com'
      WHEN 2 THEN 'User' || c_custkey || '@Shop.COM' WHEN 3 THEN 'user' || c_custkey || '@shop.cim'
      WHEN 4 THEN 'user' || c_custkey || '.example.com' WHEN 5 THEN ' USER' || (c_custkey + 1) || '@MAIL.NET '
      WHEN 6 THEN 'user' || c_custkey || '@mail.net' WHEN 7 THEN 'user' || c_custkey || '@shop.online'
      WHEN 8 THEN 'USER' || c_custkey || '@shop.CMO' WHEN 9 THEN 'frontdesk@hub.io'
      WHEN 10 THEN 'frontdesk@hub.io' WHEN 11 THEN '   ' WHEN 12 THEN 'sales@hub.io'
      WHEN 13 THEN 'a@@b.com' ELSE 'user' || c_custkey || '@mail.org' END AS email_raw,
    {_OWNER.format(k="c_custkey", gap=11)} AS owner_raw,
    CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS lifecycle_stage,
    CASE WHEN c_custkey % 19 <> 0 THEN {_COUNTRY.format(k="c_nationkey")} END AS country_raw,
    o.create_date, o.last_activity_date
  FROM customer LEFT JOIN (
    SELECT o_custkey, min(o_orderdate) AS create_date, max(o_orderdate) AS last_activity_date
    FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey),
contacts AS (
  SELECT record_id, last_name, nullif(trim(email_raw), '') AS email, nullif(trim(owner_raw), '') AS owner,
    lifecycle_stage, nullif(trim(country_raw), '') AS country, create_date, last_activity_date,
    email_raw, country_raw
  FROM contact_export),
companies AS (
  SELECT CAST(page_id AS VARCHAR) AS record_id,
    CASE page_id % 5 WHEN 0 THEN 'Vendor ' || (page_id // 5) || ' Inc.' WHEN 1 THEN 'VENDOR ' || (page_id // 5) || ', LLC'
      WHEN 2 THEN 'The Group' WHEN 3 THEN 'Vendor-' || page_id || ' GmbH'
      ELSE 'Vendor ' || (page_id // 5) || ' Holdings' END AS company_name,
    CASE WHEN page_id % 29 <> 0 THEN url END AS domain,
    trim({_OWNER.format(k="page_id", gap=7)}) AS owner,
    CASE WHEN page_id % 6 <> 0 THEN 'Industry ' || (page_id % 4) END AS industry,
    CAST(page_id % 1000 AS DOUBLE) AS num_employees,
    trim({_COUNTRY.format(k="page_id % 25")}) AS country,
    {_COUNTRY.format(k="page_id % 25")} AS country_raw
  FROM pages),
deals AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'Order ' || o_orderkey AS deal_name,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'Closed Won' WHEN o_orderstatus = 'F' THEN 'closed_lost'
      WHEN o_orderstatus = 'P' AND o_orderkey % 9 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'contractsent'
      ELSE 'Qualified To Buy' END AS deal_stage,
    CASE WHEN o_orderkey % 23 <> 0 THEN o_totalprice END AS amount,
    trim({_OWNER.format(k="o_orderkey", gap=31)}) AS owner,
    o_orderpriority AS pipeline, l.close_date, o_orderdate AS create_date, o_orderdate AS last_activity_date,
    o_orderstatus IS DISTINCT FROM 'F' AS is_open
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS close_date FROM lineitem GROUP BY l_orderkey) l
    ON l_orderkey = o_orderkey)"""

_DIMENSIONS = """
country_names(key, name, region) AS (VALUES
  ('u s a', 'United States', 'North America'), ('united states', 'United States', 'North America'),
  ('canada', 'Canada', 'North America'), ('mexico', 'Mexico', 'North America'),
  ('brasil', 'Brazil', 'LATAM'), ('argentina', 'Argentina', 'LATAM'), ('chile', 'Chile', 'LATAM'),
  ('peru', 'Peru', 'LATAM'), ('uk', 'United Kingdom', 'EMEA'), ('great britain', 'United Kingdom', 'EMEA'),
  ('deutschland', 'Germany', 'EMEA'), ('france', 'France', 'EMEA'), ('the netherlands', 'Netherlands', 'EMEA'),
  ('czech republic', 'Czechia', 'EMEA'), ('kenya', 'Kenya', 'EMEA'), ('uae', 'United Arab Emirates', 'EMEA'),
  ('japan', 'Japan', 'APAC'), ('india', 'India', 'APAC'), ('republic of korea', 'South Korea', 'APAC'),
  ('australia', 'Australia', 'APAC'), ('singapore', 'Singapore', 'APAC'), ('new zealand', 'New Zealand', 'APAC')),
owner_names(key, region) AS (VALUES ('ada novak', 'North America'), ('ben okafor', 'EMEA'),
  ('chloe ruiz', 'LATAM'), ('dmitri sato', 'APAC'))"""


def _country_key(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), '')"


def _owner_key(x: str) -> str:
    return f"nullif(lower(regexp_replace(trim({x}), '\\s+', ' ', 'g')), '')"


def _domain_key(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower(trim({x})), '^https?://', ''), '^www\\.', '')"
    return f"nullif(trim(split_part({bare}, '/', 1)), '')"


def _company_key(x: str) -> str:
    words = f"string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    legal = (
        "'inc','incorporated','llc','llp','ltd','limited','gmbh','ag','bv','nv','sa','sas','srl','spa',"
        "'plc','pty','corp','corporation','company','co','group','holdings','holding','partners','the'"
    )
    return f"nullif(array_to_string(list_filter({words}, lambda w: w NOT IN ({legal})), ' '), '')"


_TLDS = (
    "'com','org','net','io','co','ai','dev','app','biz','info','me','xyz','cloud','tech','us','uk','ca',"
    "'de','fr','es','it','nl','se','no','fi','dk','ie','ch','at','be','pt','pl','cz','gr','au','nz','sg',"
    "'jp','cn','in','hk','kr','my','ph','th','id','br','mx','ar','cl','ae','sa','za','ng','ke','eu','edu','gov'"
)
_VALID = "regexp_full_match(e, '[^@\\s]+@[^@\\s]+\\.[^@\\s.]+')"
_LIKELY = """CASE WHEN levenshtein(tld, 'com') = 1 THEN 'com' WHEN levenshtein(tld, 'net') = 1 THEN 'net'
  WHEN levenshtein(tld, 'org') = 1 THEN 'org' WHEN levenshtein(tld, 'io') = 1 THEN 'io'
  WHEN levenshtein(tld, 'co') = 1 THEN 'co' END"""


def _diagnosed(source: str, key: str, email: str) -> str:
    """Every address with the first problem that applies."""
    return f"""
    SELECT record_id, address, e, tld, likely, local_part,
      CASE WHEN e IS NULL THEN NULL WHEN NOT {_VALID} THEN 'invalid_syntax'
        WHEN tld NOT IN ({_TLDS}) THEN 'suspicious_tld'
        WHEN local_part IN ('info', 'sales', 'admin', 'support', 'contact', 'hello', 'office', 'team', 'help',
          'no-reply', 'noreply') THEN 'role_based' END AS problem
    FROM (SELECT *, {_LIKELY} AS likely FROM (
      SELECT *, split_part(e, '@', 1) AS local_part, nullif(list_last(string_split(split_part(e, '@', 2), '.')), '') AS tld
      FROM (SELECT {key} AS record_id, trim({email}) AS address, nullif(lower(trim({email})), '') AS e FROM {source})))"""


def _clusters(source: str, key: str, id_: str = "record_id") -> str:
    return f"""
    SELECT record_id, key, master FROM (
      SELECT record_id, key, first_value(record_id) OVER (PARTITION BY key ORDER BY length(record_id), record_id) AS master
      FROM (SELECT CAST({id_} AS VARCHAR) AS record_id, {key} AS key FROM {source}) WHERE key IS NOT NULL)
    WHERE record_id <> master"""


def _gap(table: str, noun: str, position: int, field: str, label: str, sev: int, reason: str) -> str:
    return f"""
    SELECT 'missing_fields_{table}' AS check_id, '{table}' AS object_type, record_id, {sev} AS sev,
      '{field}' AS field, {position} AS ord, '{noun} has no {label}: {reason}.' AS message,
      '{reason}' AS policy_reason
    FROM {table} WHERE {field} IS NULL"""


_GAPS = [
    ("contacts", "Contact", 0, "email", "Email", 3, "without an address nobody can reach or match this person"),
    ("contacts", "Contact", 1, "owner", "Owner", 3, "nobody is responsible for following up"),
    ("contacts", "Contact", 2, "lifecycle_stage", "Lifecycle Stage", 3,
     "scoring, nurturing and funnel reports skip it"),
    ("contacts", "Contact", 3, "country", "Country/Region", 2, "it cannot be assigned to a territory"),
    ("companies", "Company", 0, "domain", "Domain", 3, "matching and enrichment both start from the domain"),
    ("companies", "Company", 1, "owner", "Owner", 3, "nobody is responsible for the account"),
    ("companies", "Company", 2, "industry", "Industry", 2, "segments and scores lose accuracy"),
    ("deals", "Deal", 0, "amount", "Amount", 3, "the forecast counts it as nothing"),
    ("deals", "Deal", 1, "close_date", "Close Date", 3, "the forecast cannot place it in a period"),
    ("deals", "Deal", 2, "owner", "Owner", 3, "nobody is responsible for moving it forward"),
]
_AMOUNT = "CASE WHEN amount IS NULL THEN '' ELSE format(' worth ${:,.0f}', amount) END"


def _misrouted(table: str, noun: str) -> str:
    return f"""
    SELECT 'routing_{table}' AS check_id, '{table}' AS object_type, record_id, 3 AS sev, 'owner' AS field, 0 AS ord,
      '{noun} in ' || country || ' belongs to ' || c.region || ', but its owner ' || owner || ' covers ' || o.region
        || '. Hand it to someone in ' || c.region || '.' AS message,
      owner, o.region AS owner_region, country AS record_country, c.region AS record_region
    FROM {table} JOIN owner_names o ON o.key = {_owner_key("owner")}
      JOIN country_names c ON c.key = {_country_key("country")}
    WHERE o.region <> c.region"""


_FINDINGS = f"""
contact_clusters AS ({_clusters("contacts", "lower(email)")}),
domain_clusters AS ({_clusters("companies", _domain_key("domain"))}),
name_clusters AS ({_clusters("companies", _company_key("company_name"))}),
diagnosed AS ({_diagnosed("contacts", "record_id", "email")}),
findings AS (
  SELECT 'duplicate_contacts' AS check_id, 'contacts' AS object_type, record_id, 3 AS sev, 'email' AS field, 0 AS ord,
    'Same email (' || key || ') as record ' || master || ', which is older. Merge this record into ' || master || '.' AS message,
    master, key AS match_key, 'email' AS match_type FROM contact_clusters
  UNION ALL BY NAME
  SELECT 'duplicate_companies' AS check_id, 'companies' AS object_type, record_id, 3 AS sev, 'domain' AS field, 0 AS ord,
    'Same web domain (' || key || ') as record ' || master || ', which is older. Merge this record into ' || master || '.' AS message,
    master, key AS match_key, 'domain' AS match_type FROM domain_clusters
  UNION ALL BY NAME
  SELECT 'duplicate_companies' AS check_id, 'companies' AS object_type, record_id, 2 AS sev, 'company_name' AS field, 0 AS ord,
    'Same name without legal words (' || key || ') as record ' || master || ', which is older. Merge this record into ' || master || '.' AS message,
    master, key AS match_key, 'company_name' AS match_type FROM name_clusters
    WHERE record_id NOT IN (SELECT record_id FROM domain_clusters)
  UNION ALL BY NAME {" UNION ALL BY NAME ".join(_gap(*g) for g in _GAPS)}
  UNION ALL BY NAME
  SELECT 'decayed_contacts' AS check_id, 'contacts' AS object_type, record_id, 2 AS sev, 'last_activity_date' AS field,
    0 AS ord, 'Silent for ' || days || ' days (about ' || (days // 30) || ' months), longer than the 183 days allowed. Win back or suppress.' AS message,
    days AS days_inactive, 183 AS threshold
  FROM (SELECT *, datesub('day', last_activity_date, d) AS days FROM contacts, as_of) WHERE days > 183
  UNION ALL BY NAME
  SELECT 'email_deliverability' AS check_id, 'contacts' AS object_type, record_id,
    CASE problem WHEN 'role_based' THEN 2 ELSE 3 END AS sev, 'email' AS field, 0 AS ord,
    CASE problem WHEN 'invalid_syntax' THEN '''' || address || ''' is not an email address and cannot receive mail.'
      WHEN 'suspicious_tld' THEN '''.' || tld || ''' is not a known domain ending'
        || coalesce(', probably meant as ''.' || likely || '''', '') || '; mail will bounce.'
      ELSE '''' || local_part || '@'' is a role mailbox, not a person; expect complaints and few replies.' END AS message,
    problem AS reason, CASE WHEN problem <> 'role_based' THEN address END AS email,
    CASE WHEN problem = 'suspicious_tld' THEN tld END AS tld,
    CASE WHEN problem = 'suspicious_tld' THEN likely END AS likely_tld,
    CASE WHEN problem = 'role_based' THEN local_part END AS local_part
  FROM diagnosed WHERE problem IS NOT NULL
  UNION ALL BY NAME {_misrouted("contacts", "Contact")}
  UNION ALL BY NAME {_misrouted("companies", "Company")}
  UNION ALL BY NAME
  SELECT 'stale_deals' AS check_id, 'deals' AS object_type, record_id, 3 AS sev, 'last_activity_date' AS field, 0 AS ord,
    'Open deal' || {_AMOUNT} || ' untouched for ' || days || ' days, limit 30. It still counts in the forecast.' AS message,
    days AS days_inactive, 30 AS threshold, amount, deal_name
  FROM (SELECT *, datesub('day', last_activity_date, d) AS days FROM deals, as_of) WHERE is_open AND days > 30
  UNION ALL BY NAME
  SELECT 'past_close_date' AS check_id, 'deals' AS object_type, record_id, 3 AS sev, 'close_date' AS field, 0 AS ord,
    'Open deal' || {_AMOUNT} || ' should have closed ' || days || ' days ago. Set a new date or close it.' AS message,
    days AS days_overdue, amount, deal_name
  FROM (SELECT *, datesub('day', close_date, d) AS days FROM deals, as_of) WHERE is_open AND days > 0),
labeled AS MATERIALIZED (
  SELECT *, CASE sev WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity FROM findings)"""

_PRICED = f"""
rates(check_id, sev, minutes) AS (VALUES ('duplicate_contacts', 3, 15), ('duplicate_companies', 3, 20),
  ('duplicate_companies', 2, 20), ('missing_fields_contacts', 3, 10), ('missing_fields_contacts', 2, 4),
  ('missing_fields_companies', 3, 10), ('missing_fields_companies', 2, 4), ('missing_fields_deals', 3, 10),
  ('missing_fields_deals', 2, 4), ('decayed_contacts', 2, 3), ('email_deliverability', 3, 5),
  ('email_deliverability', 2, 3), ('routing_contacts', 3, 20), ('routing_companies', 3, 20),
  ('stale_deals', 3, 15), ('past_close_date', 3, 10)),
neglected AS (
  SELECT record_id, check_id, amount, days, factor,
    row_number() OVER (PARTITION BY record_id ORDER BY (amount IS NOT NULL AND factor > 0) DESC, amount * factor DESC, check_id) AS rn
  FROM (SELECT *, CASE WHEN days >= 90 THEN 0.75::DOUBLE WHEN days >= 60 THEN 0.5::DOUBLE
      WHEN days >= 30 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS factor
    FROM (SELECT record_id, check_id, amount, coalesce(days_inactive, days_overdue) AS days FROM labeled
      WHERE check_id IN ('stale_deals', 'past_close_date')))),
exposure AS MATERIALIZED (
  SELECT record_id, check_id, days, factor, amount,
    CASE WHEN rn = 1 AND amount IS NOT NULL AND factor > 0 THEN {_round("amount * factor", 2)} ELSE 0.0::DOUBLE END AS at_risk_usd
  FROM neglected),
priced AS (
  SELECT l.*, CAST(coalesce(r.minutes, 5) AS DOUBLE) AS minutes, coalesce(r.minutes, 5) * 1.25::DOUBLE AS cost,
    coalesce(x.at_risk_usd, 0.0::DOUBLE) AS at_risk_usd
  FROM labeled l LEFT JOIN rates r ON r.check_id = l.check_id AND r.sev = l.sev
    LEFT JOIN exposure x ON x.record_id = l.record_id AND x.check_id = l.check_id)"""


def _totals(only_deals: bool = False) -> str:
    where = "WHERE object_type = 'deals'" if only_deals else ""
    return f"""
    cost AS (SELECT *,
        CASE WHEN total_open_pipeline_usd = 0 THEN 0.0::DOUBLE ELSE at_risk_pipeline_usd / total_open_pipeline_usd END AS at_risk_share,
        direct_cost_usd + at_risk_pipeline_usd AS value_at_stake_usd
      FROM (SELECT {_round("sum(minutes) / 60.0::DOUBLE", 1)} AS remediation_hours, {_round("sum(cost)", 2)} AS direct_cost_usd,
          {_round("sum(at_risk_usd)", 2)} AS at_risk_pipeline_usd FROM priced {where}),
        (SELECT {_round("sum(coalesce(amount, 0.0))", 2)} AS total_open_pipeline_usd FROM deals WHERE is_open))"""


_SCORES = f"""
sizes AS (SELECT 'contacts' AS object_type, count(*) AS total FROM contacts UNION ALL
  SELECT 'companies', count(*) FROM companies UNION ALL SELECT 'deals', count(*) FROM deals),
penalties AS (SELECT object_type, record_id, CAST(least(sum(sev), 6) AS BIGINT) AS penalty FROM labeled GROUP BY ALL),
lost AS (
  SELECT object_type, CAST(total AS BIGINT) AS total, coalesce(points, 0) AS points, coalesce(affected, 0) AS affected
  FROM sizes LEFT JOIN (SELECT object_type, sum(penalty) AS points, count(*) AS affected FROM penalties GROUP BY ALL) USING (object_type)),
summed AS (SELECT * FROM lost UNION ALL SELECT 'overall', sum(total), sum(points), sum(affected) FROM lost),
scores AS (
  SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade
  FROM (SELECT object_type, {_round("100.0::DOUBLE * (total - points / 6.0::DOUBLE) / total", 1)} AS score,
      CAST(total - affected AS BIGINT) AS clean_records, CAST(affected AS BIGINT) AS affected_records,
      CAST(total AS BIGINT) AS total_records, (total - affected) / total::DOUBLE AS clean_rate
    FROM summed))"""

_GAINS = f"""
rescored AS (
  SELECT check_id, sum(penalty) AS points FROM (
    SELECT c.check_id, f.object_type, f.record_id, least(sum(f.sev), 6) AS penalty
    FROM (SELECT DISTINCT check_id FROM labeled) c, labeled f WHERE f.check_id <> c.check_id GROUP BY ALL) GROUP BY ALL),
gains AS (
  SELECT check_id, {_round("score_without - score", 1)} AS score_gain FROM (
    SELECT check_id, score, {_round("100.0::DOUBLE * (total_records - points / 6.0::DOUBLE) / total_records", 1)} AS score_without
    FROM rescored, (SELECT * FROM scores WHERE object_type = 'overall')))"""

_ITEMS = f"""
items AS (
  SELECT check_id AS priority_check, CASE check_id
      WHEN 'duplicate_contacts' THEN 'Duplicate Contacts' WHEN 'duplicate_companies' THEN 'Duplicate Companies'
      WHEN 'missing_fields_contacts' THEN 'Missing Required Fields — Contact'
      WHEN 'missing_fields_companies' THEN 'Missing Required Fields — Company'
      WHEN 'missing_fields_deals' THEN 'Missing Required Fields — Deal' WHEN 'decayed_contacts' THEN 'Decayed Contacts'
      WHEN 'email_deliverability' THEN 'Email Deliverability Risk' WHEN 'routing_contacts' THEN 'Territory Routing — Contact'
      WHEN 'routing_companies' THEN 'Territory Routing — Company' WHEN 'stale_deals' THEN 'Stale Deals'
      ELSE 'Deals Past Close Date' END AS issue,
    any_value(object_type) AS object, count(*) AS records,
    CASE max(sev) WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity,
    {_round("sum(minutes) / 60.0::DOUBLE", 1)} AS hours_to_fix, {_round("sum(cost)", 2)} AS cost_usd,
    {_round("sum(at_risk_usd)", 2)} AS at_risk_usd, any_value(score_gain) AS score_gain,
    first(message ORDER BY sev DESC, cost DESC, record_id, ord) AS example
  FROM priced JOIN gains USING (check_id) GROUP BY check_id)"""


def _sql(body: str, *parts: str) -> str:
    return f"WITH {', '.join(parts)} {body}"


def _found(body: str) -> str:
    return _sql(body, _TABLES, _DIMENSIONS, _FINDINGS)


def _money(body: str) -> str:
    return _sql(body, _TABLES, _DIMENSIONS, _FINDINGS, _PRICED)


def _ranked(body: str) -> str:
    return _sql(body, _TABLES, _DIMENSIONS, _FINDINGS, _PRICED, _SCORES, _GAINS, _ITEMS)


def _template(table: str, headers: dict[str, str]) -> str:
    cells = ", ".join(
        f"CASE WHEN bool_or(field = '{f}') THEN '' ELSE 'n/a' END AS \"{h}\"" for f, h in headers.items()
    )
    return _found(
        f'SELECT record_id AS "Record ID", {cells} FROM labeled '
        f"WHERE check_id = 'missing_fields_{table}' GROUP BY record_id"
    )


_DUPLICATE = """SELECT record_id, severity, field, master AS master_record_id, match_key, match_type, master AS related
  FROM labeled WHERE check_id = '{}'"""
_MISSING = """SELECT record_id, severity, field, message, field AS required_field, policy_reason
  FROM labeled WHERE check_id = 'missing_fields_{}'"""
_ROUTED = """SELECT record_id, message, owner, owner_region, record_country, record_region
  FROM labeled WHERE check_id = 'routing_{}'"""
_FLAT = """SELECT check_id, object_type, record_id, severity, CAST(sev AS INTEGER) AS severity_rank, message, field,
  {cost} AS revenue_impact_usd, coalesce(master, '') AS related_record_ids, {risk} AS at_risk_usd"""
_POSITION = ", row_number() OVER (ORDER BY sev DESC, check_id, record_id, ord, message) AS position"
_EMAIL_FIX = """SELECT record_id AS "Record ID", lower(trim(email_raw)) AS "Email" FROM contacts
  WHERE trim(email_raw) <> '' AND {} <> lower(trim(email_raw))
    AND record_id NOT IN (SELECT record_id FROM contact_clusters)"""
_COUNTRY_FIX = 'SELECT record_id AS "Record ID", name AS "Country/Region" FROM {} JOIN country_names ON key = ' + \
    _country_key("country") + " WHERE {} <> name"
_TYPO_FIX = """SELECT record_id AS "Record ID", email AS "Current Email",
  CASE WHEN ends_with({}, tld) THEN left(email, length(email) - length(tld)) || likely_tld ELSE '' END AS "Suggested Email",
  '' AS "Confirmed? (yes/no)"
  FROM labeled WHERE reason = 'suspicious_tld' AND likely_tld IS NOT NULL"""
_DEAL_FIX = """SELECT record_id AS "Record ID", deal_name AS "Deal Name",
  CASE check_id WHEN 'stale_deals' THEN 'Stale' ELSE 'Past close date' END AS "Issue",
  CAST(coalesce(days_inactive, days_overdue) AS INTEGER) AS "Days", amount AS "Amount", at_risk_usd AS "At Risk (USD)",
  '' AS "Decision (chase / re-date / close)" FROM priced WHERE check_id IN ('stale_deals', 'past_close_date')"""
_FIX_TABLES = (
    ("worklist_pipeline_review.csv", _DEAL_FIX),
    ("worklist_merge_duplicates.csv", "SELECT 1 FROM labeled WHERE check_id LIKE 'duplicate_%'"),
    ("worklist_reassign_owners.csv", "SELECT 1 FROM labeled WHERE check_id LIKE 'routing_%'"),
    ("import_contacts_email_normalized.csv", _EMAIL_FIX.format("trim(email_raw)")),
    ("import_contacts_country_standardized.csv", _COUNTRY_FIX.format("contacts", "trim(country_raw)")),
    ("import_companies_country_standardized.csv", _COUNTRY_FIX.format("companies", "trim(country_raw)")),
    ("review_email_typos.csv", _TYPO_FIX.format("email")),
    *[(f"template_{t}_missing_fields.csv", f"SELECT DISTINCT record_id FROM labeled WHERE check_id = 'missing_fields_{t}'")
      for t in ("contacts", "companies", "deals")],
)
_HEADLINE = """SELECT *, format('Grade {} with {:.0f} points: {:,} of {:,} records need work ({:,} findings). Repair takes {:,.0f} hours, or ${:,.0f}; neglected deals expose ${:,.0f}.',
    grade, score, affected_records, total_records, findings_total, remediation_hours, direct_cost_usd, at_risk_pipeline_usd) AS headline
  FROM (SELECT * EXCLUDE (object_type) FROM scores WHERE object_type = 'overall'), cost,
    (SELECT count(*) FILTER (WHERE sev = 3) AS high_findings, count(*) FILTER (WHERE sev = 2) AS medium_findings,
      count(*) FILTER (WHERE sev = 1) AS low_findings, count(*) AS findings_total FROM labeled)"""
_OWNERS = """SELECT owner FROM contacts UNION SELECT owner FROM companies UNION SELECT owner FROM deals"""
_BLANK = "SELECT '{0}' AS column_name, count(*) FILTER (WHERE {1} IS NULL OR trim({1}) = '') AS blanks FROM contact_export"
_TEXT_KEY = r"md5(nullif(lower(trim(text, E' \t\n\r')), ''))"


def _queries() -> dict[str, str]:
    return {
        "csv_contacts": _sql(
            """SELECT record_id, CAST(NULL AS VARCHAR) AS first_name, last_name, email, CAST(NULL AS VARCHAR) AS phone,
              CAST(NULL AS VARCHAR) AS job_title, owner, lifecycle_stage, CAST(NULL AS VARCHAR) AS lead_status, country,
              CAST(NULL AS VARCHAR) AS associated_company_id, create_date, last_activity_date, email_raw, country_raw
            FROM contacts""", _TABLES),
        "csv_multiline_contacts": _sql(
            """SELECT record_id, last_name, CASE WHEN CAST(record_id AS INTEGER) % 7 < 3
                THEN 'Buyer' || chr(10) || 'no. "' || record_id || '",' || chr(10) || chr(10) || 'and "more"' END AS job_title,
              email, owner FROM contacts""", _TABLES),
        "conformed_companies": _sql(
            """SELECT record_id, company_name, domain, owner, industry, num_employees, country,
              CAST(NULL AS TIMESTAMP) AS create_date, CAST(NULL AS TIMESTAMP) AS last_activity_date, country_raw
            FROM companies""", _TABLES),
        "conformed_deals": _sql(
            """SELECT record_id, deal_name, deal_stage, amount, owner, pipeline, close_date, create_date,
              last_activity_date, CAST(NULL AS VARCHAR) AS associated_company_id FROM deals""", _TABLES),
        "reference_date": "SELECT max(o_orderdate) AS as_of FROM orders",
        "record_counts": _sql("SELECT * FROM sizes", _TABLES, _SCORES.split("penalties AS")[0].rstrip().rstrip(",")),
        "email_parts": _sql(
            f"""SELECT record_id, e AS email_key, local_part, domain, is_valid, tld, is_suspicious,
              CASE WHEN is_suspicious THEN {_LIKELY} END AS likely_tld FROM (
              SELECT *, coalesce(tld NOT IN ({_TLDS}), false) AS is_suspicious, coalesce({_VALID}, false) AS is_valid FROM (
              SELECT *, nullif(list_last(string_split(domain, '.')), '') AS tld FROM (
              SELECT record_id, e, CASE WHEN p > 1 AND p < length(e) THEN left(e, p - 1) END AS local_part,
                CASE WHEN p > 1 AND p < length(e) THEN substr(e, p + 1) END AS domain
              FROM (SELECT record_id, nullif(lower(trim(email_raw)), '') AS e, instr(lower(trim(email_raw)), '@') AS p FROM contacts))))""",
            _TABLES),
        "company_keys": _sql(f"SELECT record_id, {_company_key('company_name')} AS company_key FROM companies", _TABLES),
        "domain_keys": f"SELECT page_id, {_domain_key('url')} AS domain_key FROM pages",
        "country_names": _sql(
            f"""SELECT record_id, {_country_key("country")} AS country_key, name AS canonical_country
            FROM contacts LEFT JOIN country_names ON key = {_country_key("country")}""", _TABLES, _DIMENSIONS),
        "owner_keys": _sql(f"SELECT record_id, {_owner_key('owner_raw')} AS owner_key FROM contact_export", _TABLES),
        "event_age_days": """SELECT event_id, CAST(floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-15 12:00:00')
            / 86400000000.0::DOUBLE) AS INTEGER) AS days FROM events""",
        "open_stages": _sql("SELECT record_id, is_open FROM deals", _TABLES),
        "blank_contact_cells": _sql(" UNION ALL ".join(_BLANK.format(*p) for p in (
            ("Email", "email_raw"), ("Contact owner", "owner_raw"), ("Lifecycle Stage", "lifecycle_stage"),
            ("Country/Region", "country_raw"))), _TABLES),
        "duplicate_contacts": _found(_DUPLICATE.format("duplicate_contacts")),
        "duplicate_companies": _found(_DUPLICATE.format("duplicate_companies")),
        "duplicate_documents": "SELECT record_id, key AS match_key, master AS master_record_id FROM ("
            + _clusters("documents", _TEXT_KEY, "doc_id") + ")",
        "duplicate_parts": f"""WITH exact AS ({_clusters("part", "p_name || '|' || p_brand", "p_partkey")}),
            named AS ({_clusters("part", "p_name", "p_partkey")})
            SELECT record_id, CAST(0 AS INTEGER) AS pass, key AS match_key, master AS master_record_id FROM exact
            UNION ALL SELECT record_id, CAST(1 AS INTEGER), key, master FROM named
            WHERE record_id NOT IN (SELECT record_id FROM exact)""",
        "missing_contact_fields": _found(_MISSING.format("contacts")),
        "missing_company_fields": _found(_MISSING.format("companies")),
        "missing_deal_fields": _found(_MISSING.format("deals")),
        "unlabeled_documents": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, quality, toxic
              FROM documents LEFT JOIN labels USING (doc_id))
            SELECT 'missing_fields_documents' AS check_id, record_id, 'High' AS severity, 'quality' AS field FROM d WHERE quality IS NULL
            UNION ALL SELECT 'missing_fields_documents', record_id, 'Medium', 'toxic' FROM d WHERE toxic IS NULL""",
        "decayed_contacts": _found("""SELECT record_id, severity, message, CAST(days_inactive AS INTEGER) AS days_inactive,
            CAST(threshold AS INTEGER) AS threshold_days FROM labeled WHERE check_id = 'decayed_contacts'"""),
        "decayed_after_months": _sql("""SELECT record_id, 'Medium' AS severity, 'Silent for ' || days || ' days (about ' || (days // 30)
              || ' months), longer than the 122 days allowed. Win back or suppress.' AS message,
              CAST(days AS INTEGER) AS days_inactive, CAST(122 AS INTEGER) AS threshold_days
            FROM (SELECT *, datesub('day', last_activity_date, d) AS days FROM contacts, as_of) WHERE days > 122""", _TABLES),
        "lapsed_buyers": """SELECT CAST(user_id AS VARCHAR) AS record_id, 'Medium' AS severity,
              'Silent for ' || days || ' days (about ' || (days // 30) || ' months), longer than the 3 days allowed. Win back or suppress.' AS message,
              CAST(days AS INTEGER) AS days_inactive, CAST(3 AS INTEGER) AS threshold_days
            FROM (SELECT user_id, datesub('day', max(ts) FILTER (WHERE event_type = 'purchase'), (SELECT max(ts) FROM events)) AS days
              FROM events GROUP BY user_id) WHERE days > 3""",
        "email_deliverability": _found("""SELECT record_id, severity, message, reason, email, tld, likely_tld, local_part
            FROM labeled WHERE check_id = 'email_deliverability'"""),
        "published_addresses": rf"""WITH found AS (
              SELECT 'd' || doc_id AS place, unnest(regexp_extract_all(text, '[^\s<>"''(),;:=]+@[^\s<>"''(),;:=]+')) AS address FROM documents
              UNION ALL SELECT 'p' || page_id, unnest(regexp_extract_all(html, '[^\s<>"''(),;:=]+@[^\s<>"''(),;:=]+')) FROM pages),
            diagnosed AS ({_diagnosed("found", "place", "address")})
            SELECT record_id, CASE problem WHEN 'role_based' THEN 'Medium' ELSE 'High' END AS severity, problem AS reason,
              CASE WHEN problem <> 'role_based' THEN address END AS email, CASE WHEN problem = 'suspicious_tld' THEN tld END AS tld,
              CASE WHEN problem = 'suspicious_tld' THEN likely END AS likely_tld FROM diagnosed WHERE problem IS NOT NULL""",
        "routing_contacts": _found(_ROUTED.format("contacts")),
        "routing_companies": _found(_ROUTED.format("companies")),
        "shipments_across_regions": """WITH places AS (SELECT n_nationkey, n_name, r_name FROM nation
              JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey NOT IN (3, 17))
            SELECT l_orderkey || '-' || l_linenumber AS record_id, s_name AS owner, sp.r_name AS owner_region,
              cp.n_name AS record_country, cp.r_name AS record_region
            FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN places sp ON sp.n_nationkey = s_nationkey
              JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
              JOIN places cp ON cp.n_nationkey = c_nationkey
            WHERE sp.r_name <> cp.r_name""",
        "stale_deals": _found("""SELECT record_id, message, CAST(days_inactive AS INTEGER) AS days_inactive,
            CAST(threshold AS INTEGER) AS threshold_days, amount FROM labeled WHERE check_id = 'stale_deals'"""),
        "past_close_date": _found("""SELECT record_id, message, CAST(days_overdue AS INTEGER) AS days_overdue, amount
            FROM labeled WHERE check_id = 'past_close_date'"""),
        "all_findings": _money(_FLAT.format(cost="cost", risk="at_risk_usd") + _POSITION + " FROM priced"),
        "selected_findings": _found(
            _FLAT.format(cost="0.0::DOUBLE", risk="0.0::DOUBLE")
            + " FROM labeled WHERE sev = 3 AND check_id IN ('email_deliverability', 'stale_deals')"),
        "subset_with_custom_check": _found("""SELECT check_id, record_id, severity, field, 12.5::DOUBLE AS revenue_impact_usd
            FROM labeled WHERE check_id = 'missing_fields_deals' UNION ALL
            SELECT 'huge_deals', record_id, 'Low', 'amount', 6.25::DOUBLE FROM deals WHERE amount > 400000"""),
        "record_penalties": _found("""SELECT object_type, record_id, CAST(least(sum(sev), 6) AS BIGINT) AS penalty
            FROM labeled GROUP BY ALL"""),
        "deal_risk": _money("""SELECT record_id, check_id, CAST(days AS INTEGER) AS days, factor, amount, at_risk_usd
            FROM exposure"""),
        "deal_exposure": _sql(
            "SELECT * FROM cost", _TABLES, _DIMENSIONS, _FINDINGS, _PRICED, _totals(only_deals=True)),
        "open_deal_value": _sql("SELECT round(sum(coalesce(amount, 0.0)), 2) AS open_usd FROM deals WHERE is_open", _TABLES),
        "cost_summary": _sql("SELECT * FROM cost", _TABLES, _DIMENSIONS, _FINDINGS, _PRICED, _totals()),
        "health_score": _sql("SELECT * FROM scores", _TABLES, _DIMENSIONS, _FINDINGS, _SCORES),
        "severity_shares": _found("""SELECT severity, CAST(sev AS INTEGER) AS severity_rank, count(*) AS findings,
            count(*) / (SELECT count(*) FROM labeled)::DOUBLE AS share FROM labeled GROUP BY ALL"""),
        "score_gains": _sql("SELECT * FROM gains", _TABLES, _DIMENSIONS, _FINDINGS, _SCORES, _GAINS),
        "punch_list": _ranked("SELECT * FROM items"),
        "start_here": _ranked("SELECT * FROM items ORDER BY at_risk_usd + cost_usd DESC, score_gain DESC, records DESC LIMIT 1"),
        "report_headline": _sql(_HEADLINE, _TABLES, _DIMENSIONS, _FINDINGS, _PRICED, _totals(), _SCORES),
        "owner_names": _sql(f"SELECT owner FROM ({_OWNERS}) WHERE owner IS NOT NULL", _TABLES),
        "routing_coverage": _sql(
            f"""SELECT count(*) AS owners_found, count(region) AS owners_assigned, count(*) - count(region) AS owners_unassigned,
              count(region) > 0 AS routing_active FROM ({_OWNERS}) o LEFT JOIN owner_names n ON n.key = {_owner_key("owner")}
            WHERE owner IS NOT NULL""", _TABLES, _DIMENSIONS),
        "finding_facets": _found("""SELECT 'object_type' AS facet, object_type AS value, count(*) AS findings FROM labeled GROUP BY ALL
            UNION ALL SELECT 'severity', severity, count(*) FROM labeled GROUP BY ALL
            UNION ALL SELECT 'check_id', check_id, count(*) FROM labeled GROUP BY ALL"""),
        "fix_email_case": _found(_EMAIL_FIX.format("trim(email_raw)")),
        "fix_email_case_and_padding": _found(_EMAIL_FIX.format("email_raw")),
        "fix_contact_countries_and_padding": _sql(_COUNTRY_FIX.format("contacts", "country_raw"), _TABLES, _DIMENSIONS),
        "fix_email_typos_any_case": _found(_TYPO_FIX.format("lower(email)")),
        "fix_contact_countries": _sql(_COUNTRY_FIX.format("contacts", "trim(country_raw)"), _TABLES, _DIMENSIONS),
        "fix_company_countries": _sql(_COUNTRY_FIX.format("companies", "trim(country_raw)"), _TABLES, _DIMENSIONS),
        "fix_email_typos": _found(_TYPO_FIX.format("email")),
        "fix_merges": _found("""SELECT CASE object_type WHEN 'contacts' THEN 'Contacts' ELSE 'Companies' END AS "Object",
            record_id AS "Merge This Record ID", master AS "Into This Record ID", match_type AS "Matched On",
            match_key AS "Matched Value", '' AS "Done? (yes/no)" FROM labeled
            WHERE check_id IN ('duplicate_contacts', 'duplicate_companies')"""),
        "fix_owners": _found("""SELECT CASE object_type WHEN 'contacts' THEN 'Contacts' ELSE 'Companies' END AS "Object",
            record_id AS "Record ID", owner AS "Current Owner", owner_region AS "Owner Covers",
            record_country AS "Record Country", record_region AS "Should Be Owned In", '' AS "New Owner (fill in)"
            FROM labeled WHERE check_id IN ('routing_contacts', 'routing_companies')"""),
        "fix_deals": _money(_DEAL_FIX),
        "fix_contact_fields": _template("contacts", {
            "country": "Country/Region", "email": "Email", "lifecycle_stage": "Lifecycle Stage", "owner": "Contact owner"}),
        "fix_company_fields": _template("companies", {
            "domain": "Company Domain Name", "industry": "Industry", "owner": "Company owner"}),
        "fix_deal_fields": _template("deals", {
            "amount": "Amount", "close_date": "Close Date", "owner": "Deal owner"}),
        "fix_table_sizes": _money(" UNION ALL ".join(
            f"SELECT '{name}' AS filename, count(*) AS rows FROM ({body})" for name, body in _FIX_TABLES)),
        "correction_manifest": _money(f"""SELECT CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS position, filename,
            CASE WHEN filename LIKE 'template%' THEN 'worklist' ELSE split_part(filename, '_', 1) END AS kind,
            CASE WHEN filename LIKE '%companies%' THEN 'companies'
              WHEN filename LIKE '%deals%' OR filename LIKE '%pipeline%' THEN 'deals' ELSE 'contacts' END AS object_type,
            rows, rows AS rows_written
            FROM ({" UNION ALL ".join(
                f"SELECT {i} AS i, '{name}' AS filename, count(*) AS rows FROM ({body})"
                for i, (name, body) in enumerate(_FIX_TABLES))}) WHERE rows > 0"""),
        "findings_file": _money(_FLAT.format(cost="cost", risk="at_risk_usd") + _POSITION + " FROM priced"),
        "report_summary": _sql(
            f"""SELECT headline, score AS overall, grade, clean_records, affected_records, remediation_hours,
              direct_cost_usd, at_risk_pipeline_usd, findings_total, high_findings, medium_findings, low_findings,
              {", ".join(f"(SELECT score FROM scores WHERE object_type = '{o}') AS {o}_score, "
                         f"(SELECT total_records FROM scores WHERE object_type = '{o}') AS {o}_records"
                         for o in ("contacts", "companies", "deals"))},
              11::BIGINT AS checks_run, (SELECT count(*) FROM items) AS items,
              (SELECT priority_check FROM items ORDER BY at_risk_usd + cost_usd DESC LIMIT 1) AS first_item
            FROM ({_HEADLINE})""",
            _TABLES, _DIMENSIONS, _FINDINGS, _PRICED, _totals(), _SCORES, _GAINS, _ITEMS),
        "loaded_findings": _found(_FLAT.format(cost="0.0::DOUBLE", risk="0.0::DOUBLE") + " FROM labeled"),
        "contacts_only_findings": _found(
            _FLAT.format(cost="0.0::DOUBLE", risk="0.0::DOUBLE") + " FROM labeled WHERE object_type = 'contacts'"),
        "exposure_of_repeated_ids": _money(f"""
            SELECT CASE WHEN CAST(record_id AS BIGINT) % 3 = 0 THEN '' ELSE CAST(CAST(record_id AS BIGINT) % 100 AS VARCHAR) END AS record_id,
              count(*) AS findings, count(*) FILTER (WHERE amount IS NOT NULL AND factor > 0) > 0 AS is_exposed,
              coalesce(max(CASE WHEN amount IS NOT NULL AND factor > 0 THEN {_round("amount * factor", 2)} END), 0.0::DOUBLE) AS at_risk_usd
            FROM exposure GROUP BY 1"""),
        "deal_name_lookup": _found("""SELECT l.record_id, l.field, d.deal_name FROM labeled l LEFT JOIN deals d USING (record_id)
            WHERE check_id = 'missing_fields_deals'"""),
    }


_FILES = {
    "worklist_pipeline_review.csv": ("fix_deals", ["Record ID", "Deal Name", "Issue", "Days", "Decision (chase / re-date / close)"]),
    "worklist_merge_duplicates.csv": (
        "fix_merges", ["Object", "Merge This Record ID", "Into This Record ID", "Matched On", "Matched Value", "Done? (yes/no)"]),
    "worklist_reassign_owners.csv": (
        "fix_owners",
        ["Object", "Record ID", "Current Owner", "Owner Covers", "Record Country", "Should Be Owned In", "New Owner (fill in)"]),
    "import_contacts_email_normalized.csv": ("fix_email_case", ["Record ID", "Email"]),
    "import_contacts_country_standardized.csv": ("fix_contact_countries", ["Record ID", "Country/Region"]),
    "import_companies_country_standardized.csv": ("fix_company_countries", ["Record ID", "Country/Region"]),
    "review_email_typos.csv": ("fix_email_typos", ["Record ID", "Current Email", "Suggested Email", "Confirmed? (yes/no)"]),
    "template_contacts_missing_fields.csv": (
        "fix_contact_fields", ["Record ID", "Country/Region", "Email", "Lifecycle Stage", "Contact owner"]),
    "template_companies_missing_fields.csv": (
        "fix_company_fields", ["Record ID", "Company Domain Name", "Industry", "Company owner"]),
    "template_deals_missing_fields.csv": ("fix_deal_fields", ["Record ID", "Amount", "Close Date", "Deal owner"]),
}


def all_sql() -> dict[str, str]:
    found = _queries()
    cells = [
        "SELECT '{}' AS filename, concat_ws('|', {}) AS cells FROM ({})".format(
            file, ", ".join(f"coalesce(CAST(\"{c}\" AS VARCHAR), '')" for c in columns if c != "Amount"), found[query])
        for file, (query, columns) in _FILES.items()
    ]
    return {**found, "correction_contents": " UNION ALL ".join(cells)}
