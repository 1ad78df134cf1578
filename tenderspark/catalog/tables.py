"""Domain tables derived from the generic test tables.

Each table is one SELECT in the SQL subset Spark and DuckDB share, so a query
and its check start from the same rows.  Three spellings differ and are
written as macros: ``ARR(`` for an array literal, ``NULLARR`` for a null one and
``SHA256(`` for the hash.
Every row of the source tables is used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tenderspark.session import spread

NL = "chr(10)"

_DATE = "lpad(cast(month({0}) as string), 2, '0') || '/' || lpad(cast(day({0}) as string), 2, '0') || '/' || cast(year({0}) as string)"

TABLES: dict[str, str] = {}

# Notices: every order; those whose key is also a document key carry its text.
TABLES["notices"] = """
select o.o_orderkey as notice_id,
  case o.o_orderkey % 3 when 0 then 'sam.gov' when 1 then 'Cal eProcure' else 'BidNet Direct' end as source,
  'N' || cast(o.o_orderkey as string) as external_id,
  coalesce(substr(replace(d.text, chr(10), ' '), 1, 60), 'Order ' || cast(o.o_orderkey as string)) as title,
  case when o.o_orderkey % 4 = 0 then cast(null as string) when o.o_orderkey % 4 = 1 then '  '
       else 'Notice ' || cast(o.o_orderkey as string) end as name,
  d.text as description,
  case when o.o_orderkey % 5 = 0 then cast(null as string)
       else ' Work on lot ' || cast(o.o_orderkey % 17 as string) || '. ' end as statement_of_work,
  case when o.o_orderkey % 6 = 0 then cast(null as string)
       when o.o_orderkey % 6 = 1 then 'CDT'
       when o.o_orderkey % 6 = 2 then 'Dept. of Technology'
       when o.o_orderkey % 6 = 3 then 'Supplier#' || lpad(cast(o.o_orderkey % 97 as string), 9, '0')
       when o.o_orderkey % 6 = 4 then 'Bureau of Regional Supplier#' || lpad(cast(o.o_orderkey % 89 as string), 9, '0') || ' Works'
       else 'Regional Works Council' end as department,
  case when o.o_custkey % 7 = 0 then cast(null as string)
       when o.o_custkey % 7 = 1 then 'Sacramento'
       when o.o_custkey % 7 = 2 then 'Port NATION_' || cast(o.o_orderkey % 25 as string)
       else 'NATION_' || cast(o.o_orderkey % 25 as string) end as location,
  case when o.o_custkey % 7 = 1 then 'California' when o.o_custkey % 14 = 0 then 'Ca' end as state,
  case when o.o_orderkey % 11 = 0 then cast(null as timestamp) else o.o_orderdate end as due_date,
  o.o_orderdate - interval 30 days as posted_date,
  case when o.o_orderkey % 9 = 0 then cast(null as double) else floor(o.o_totalprice * 5) end as amount_min,
  case when o.o_orderkey % 7 = 0 then cast(null as double)
       when o.o_orderkey % 7 = 1 then floor(o.o_totalprice * 5) else floor(o.o_totalprice * 12) end as amount_max,
  ARR(case o.o_orderkey % 8 when 0 then 'Software' when 1 then 'Cloud' when 2 then 'Data' when 3 then 'Health Services'
        when 4 then 'Construction' when 5 then 'Servers' when 6 then 'Sacramento' else 'Training' end,
      substr(o.o_orderpriority, 3)) as tags,
  ARR('Deliver lot ' || cast(o.o_orderkey % 13 as string), 'Report monthly') as deliverables,
  case o.o_orderstatus when 'O' then 'active' when 'P' then 'amended' else 'closed' end as status,
  o.o_orderkey % 10 <> 3 as is_relevant,
  case when o.o_orderkey % 5 < 3 then 'SBA' when o.o_orderkey % 5 = 3 then ' ' end as set_aside,
  ARR(cast(541500 + o.o_orderkey % 20 as string), cast(511200 + o.o_custkey % 11 as string)) as naics_codes,
  case o.o_orderkey % 4 when 0 then 'Solicitation' when 1 then 'Special Notice' when 2 then 'RFI' else '' end as event_type,
  'v1-N' || cast(o.o_orderkey as string) || '-' || substr(SHA256(cast(o.o_totalprice as string)), 1, 12) as content_hash
from {orders} o left join {documents} d on o.o_orderkey = d.doc_id
"""

TABLES["contractors"] = """
select c.c_custkey as contractor_id,
  'user' || cast(c.c_custkey % 1000 as string) as user_id,
  c.c_name as company_name,
  ARR(c.c_mktsegment, case when c.c_custkey % 3 = 0 then 'Software' else ' Cloud ' end) as industries,
  ARR(case when c.c_custkey % 2 = 0 then 'Data' else 'Health Services' end, 'services') as sub_industries,
  case when c.c_custkey % 4 = 0 then '  ' when c.c_custkey % 4 = 1 then cast(null as string)
       else 'Grow ' || lower(c.c_mktsegment) || ' work near ' || n.n_name end as goals,
  case when c.c_custkey % 13 = 0 then ARR('Nationwide')
       when c.c_custkey % 17 = 0 then ARR(' ')
       else ARR(n.n_name, 'Northern California') end as preferred_locations,
  ARR('ISO ' || cast(9000 + c.c_custkey % 3 as string)) as certifications,
  case when c.c_custkey % 2 = 0 then ARR('sba', 'WOSB') else ARR('8(a)') end as set_aside_eligibility,
  ARR(cast(541500 + c.c_custkey % 30 as string), cast(511210 + c.c_custkey % 7 as string)) as naics_codes,
  ARR(case when c.c_custkey % 5 = 0 then 'training' when c.c_custkey % 5 = 1 then 'order 1' else 'x' end, 'not specified work', ' Urgent ') as exclusions,
  case when c.c_custkey % 6 = 0 then cast(null as double) else c.c_acctbal end as preferred_contract_min,
  case when c.c_custkey % 9 = 0 then cast(null as int) else cast(c.c_custkey % 30 as int) end as preferred_response_window_days,
  timestamp '2024-01-10 00:00:00' + interval 1 minutes * cast(c.c_custkey % 20000 as int) as updated_at
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey
"""

TABLES["past_projects"] = """
select o.o_orderkey as project_id, o.o_custkey as contractor_id,
  case when o.o_orderkey % 10 = 0 then 'Experience profile' else 'Project ' || cast(o.o_orderkey as string) end as project_name,
  case when o.o_orderkey % 8 = 0 then cast(null as string)
       else 'Delivered ' || lower(substr(o.o_orderpriority, 3)) || ' priority work' end as description,
  case when o.o_orderkey % 5 = 0 then cast(null as string)
       when o.o_orderkey % 5 = 1 then 'CDT'
       when o.o_orderkey % 5 = 2 then upper('department of technology')
       when o.o_orderkey % 5 = 3 then 'Regional Works Council of Supplier#' || lpad(cast(o.o_orderkey % 89 as string), 9, '0')
       else ' Supplier#' || lpad(cast(o.o_orderkey % 97 as string), 9, '0') end as client,
  o.o_totalprice as contract_value,
  ARR(substr(o.o_orderpriority, 3), case when o.o_orderkey % 3 = 0 then 'cloud' else 'Server racks' end) as tags
from {orders} o
"""

# Notices that events are about: all notices and a fifth more ids that no notice has.
_NOTICE = "(e.event_id * 7) % (select cast(floor(count(*) * 1.25) as bigint) from {orders})"

TABLES["scores"] = f"""
select e.event_id as score_id, e.user_id as contractor_id, {_NOTICE} as notice_id,
  least(100.0, e.value) as score, 'r' || cast(e.event_id as string) as reasoning,
  case when e.event_id % 3 = 0 then 'compat-v1' else 'compat-v2' end as model_version, e.ts as computed_at
from {{events}} e where e.event_type in ('click', 'error', 'signup')
"""

TABLES["saved"] = f"""
select e.user_id as contractor_id, e.notice_id, max(e.ts) as saved_at,
  cast(case when max(e.event_id) % 3 = 0 then null else max(e.event_id) % 7 end as int) as sort_position,
  case max(e.event_id) % 5 when 0 then cast(null as string) when 1 then 'reviewing' when 2 then 'pursuing'
       when 3 then 'no_bid' else 'submitted' end as bid_status,
  case when max(e.event_id) % 2 = 0 then 'note ' || cast(max(e.event_id) as string) end as notes
from (select e.*, {_NOTICE} as notice_id from {{events}} e where e.event_type = 'purchase') e group by e.user_id, e.notice_id
"""

TABLES["views"] = f"""
select e.event_id as view_id, e.user_id as contractor_id, {_NOTICE} as notice_id, e.ts as viewed_at
from {{events}} e where e.event_type = 'view'
"""

TABLES["summaries"] = f"""
select e.event_id as summary_id, {_NOTICE.replace('1.25', '2.5')} as notice_id,
  case when e.event_id % 4 = 0 then 'contractor' else 'general' end as summary_type,
  case e.event_id % 3 when 0 then 'detailed-v4' when 1 then 'detailed-v3' end as prompt_version,
  'summary ' || cast(e.event_id as string) as summary, e.ts as generated_at
from {{events}} e
"""

_JUDGEMENT = """
select s.contractor_id, s.notice_id, '{0}' as factor, cast((s.contractor_id * 31 + s.notice_id * 17 + {1}) % 101 as int) as score,
  'because {0}' as reason, cast((s.notice_id + {1}) % 4 as int) as n_met, cast((s.notice_id * 3 + {1}) % 3 as int) as n_unmet
from {{saved}} s
"""
TABLES["judgements"] = " union all ".join(
    _JUDGEMENT.format(factor, salt) for factor, salt in (("experience", 1), ("goals", 2), ("prereqs", 3)))

# One vector per chunk; `label` stands for the notice it was cut from.
TABLES["chunks"] = """
select vec_id as chunk_id, label as notice_id, 'chunk text ' || cast(vec_id as string) as chunk_text, embedding from {embeddings}
"""

# Notice headers as the portals write them.
TABLES["raw_records"] = """
select o.o_orderkey as notice_id,
  case o.o_orderkey % 7 when 0 then ' SAM.gov' when 1 then 'BidNet' when 2 then 'calprocure ' when 3 then 'Planet Bids'
       when 4 then cast(null as string) when 5 then 'Cal eProcure' else 'Elsewhere' end as source,
  case o.o_orderkey % 6 when 0 then ' Closed' when 1 then 'inactive' when 2 then 'AWARDED' when 3 then cast(null as string)
       when 4 then 'cancelled' else 'Amended' end as status,
  case o.o_orderkey % 6 when 0 then '(916) 653-' || lpad(cast(o.o_orderkey % 10000 as string), 4, '0')
       when 1 then '+1 916.653.' || lpad(cast(o.o_orderkey % 10000 as string), 4, '0')
       when 2 then 'n/a' when 3 then '44 20 7946 ' || cast(o.o_orderkey % 1000 as string) when 4 then cast(null as string)
       else '653-' || cast(o.o_orderkey % 100 as string) end as contact_phone,
  case o.o_orderkey % 5 when 0 then ' Pat.' || cast(o.o_orderkey as string) || '@Mail.EXAMPLE.Org ' when 1 then 'Nobody Home'
       when 2 then 'A@b@HOST.gov' when 3 then cast(null as string) else 'x@Y.z' end as contact_email,
  case o.o_orderkey % 3 when 0 then '  ' when 1 then ' Pat Doe ' || cast(o.o_orderkey as string) end as contact_name,
  case when o.o_orderkey % 9 = 0 then cast(null as string)
       else '  Lot ' || cast(o.o_orderkey as string) || chr(10) || chr(9) || ' of   goods ' end as title,
  case o.o_orderkey % 12 when 0 then 'cdt' when 1 then ' Dept. of  Technology' when 2 then 'Caltrans' when 3 then cast(null as string)
       when 4 then 'Ofc of Emergency Svcs' when 5 then 'Dept of Info Tech, Mgmt; and Admin.' when 6 then 'Departmnt of Water Resources'
       when 7 then 'California State Park' when 8 then 'Department of Health Care Srvcs' when 9 then '  '
       when 10 then 'Board ' || cast(o.o_orderkey % 300 as string) || ' of Cannabis Control Dept' else 'Judicial Branch Califronia' end as dept,
  case o.o_orderkey % 4 when 0 then 'https://drive.example.com/file/d/ID' || cast(o.o_orderkey as string) || '/view?usp=x'
       when 1 then 'https://drive.example.com/open?id=Q' || cast(o.o_orderkey as string) || '&a=b' when 2 then 'https://x.org/none'
       else 'https://drive.example.com/uc?export=1&id=Z' || cast(o.o_orderkey as string) end as url,
  case o.o_orderkey % 3 when 0 then '..Lot/7 #' || cast(o.o_orderkey as string) || '__' when 1 then '///' else 'A-' || cast(o.o_orderkey as string) || '.v2' end as notice_code,
  case o.o_orderkey % 4 when 0 then '0' || cast(1 + o.o_orderkey % 9 as string) || '/1' || cast(o.o_orderkey % 10 as string) || '/2026  1:05PM PDT'
       when 1 then '12/31/2026 12:30 AM EST' when 2 then 'due 3/8/2026' else 'not a date' end as stamp,
  o.o_orderdate, o.o_totalprice, o.o_orderpriority, d.text as description
from {orders} o left join {documents} d on o.o_orderkey = d.doc_id
"""

_TITLE = "substr(replace(d.text, chr(10), ' '), 1, 40)"
# Landed page text of the state portal: a header block, the body and trailers.
TABLES["portal_text"] = f"""
select d.doc_id, lpad(cast(d.doc_id as string), 10, '0') as external_id,
  'https://portal.example.org/event/4300/' || lpad(cast(d.doc_id as string), 10, '0') || case when d.doc_id % 3 = 0 then '?a=1' else '' end as url,
  'Event Details' || chr(10) || 'Event : ' || lpad(cast(d.doc_id as string), 10, '0') || chr(10)
  || {_TITLE} || chr(10)
  || 'Format/Type:' || chr(10) || 'Sell Event' || chr(10)
  || 'Dept:' || chr(10) || case d.doc_id % 5 when 0 then 'Dept of Parks & Recreation' when 1 then 'CDT' when 2 then 'Ofc  Water Mgmt'
       when 3 then 'Department of Water Resource' else 'California Franchise Tax Bord' end || chr(10)
  || 'Published Date' || chr(10) || lpad(cast(1 + d.doc_id % 12 as string), 2, '0') || '/' || lpad(cast(1 + d.doc_id % 28 as string), 2, '0') || '/2026  1:00PM PDT' || chr(10)
  || 'Event End Date:' || chr(10) || lpad(cast(1 + d.doc_id % 12 as string), 2, '0') || '/' || lpad(cast(2 + d.doc_id % 27 as string), 2, '0') || '/2026 12:30 AM' || chr(10)
  || case when d.doc_id % 4 = 0 then '4. Description' || chr(10) when d.doc_id % 4 = 1 then 'Description:' || chr(10) else '' end
  || case when d.doc_id % 6 = 0 then '1/8/26' || chr(10) || 'This is Addendum 4. New dates.' || chr(10) || chr(10) else '' end
  || case when d.doc_id % 6 = 1 then '1/7/2026 - Addendum 3 has been posted.' || chr(10) || 'The agency posted this.' || chr(10) || chr(10) else '' end
  || case when d.doc_id % 6 = 2 then '2/7/2026' || chr(10) || 'Plain update line for bidders to read.' || chr(10) || chr(10) else '' end
  || case when d.doc_id % 3 = 0 then 'This is a combined synopsis for items. NAICS: 541511 applies here. ' else '' end
  || case when d.doc_id % 3 = 1 then 'The department is seeking a software system for the city of Fresno, CA and its partners. ' else '' end
  || case when d.doc_id % 5 = 1 then 'The contractor shall provide monthly status reports to the agency. The vendor must submit a form. Staff will provide training for the users of the platform. ' else '' end
  || replace(d.text, chr(10), chr(10) || chr(10))
  || case when d.doc_id % 7 = 0 then chr(10) || 'Scope of Work:' || chr(10) || '- Provide cloud hosting for the data of the agency' || chr(10)
       || '* Deliver support to the users in the field offices;' || chr(10) || '3) Maintain the network and the servers of the state' || chr(10)
       || 'CONTRACT TERMS' || chr(10) || '- Not part of the section but a bullet of the text' || chr(10) else '' end
  || case when d.doc_id % 8 = 1 then chr(10) || 'The system includes account creation and login, plan selection and enrollment, and nightly data exchange jobs, etc. More text.' else '' end
  || chr(10) || 'UNSPSC Codes' || chr(10) || cast(43200000 + d.doc_id * 37 as string) || ' Software' || chr(10) || '20260514 01012001 ' || cast(81110000 + d.doc_id % 100 as string)
  || chr(10) || 'Contact Information' || chr(10) || 'Pat Doe ' || cast(d.doc_id as string) || chr(10)
  || case when d.doc_id % 2 = 0 then 'Phone: 760/770-' || lpad(cast(d.doc_id % 10000 as string), 4, '0') else 'call (916) 653-' || lpad(cast(d.doc_id % 10000 as string), 4, '0') end || chr(10)
  || 'pat' || cast(d.doc_id as string) || '@Example.ORG' || chr(10) || 'Pre Bid Conference(N/A)' as text
from {{documents}} d
"""

# A notice description as it reaches enrichment.
TABLES["descriptions"] = f"""
select d.doc_id, {_TITLE} as title,
  case d.doc_id % 4 when 0 then cast(null as string) when 1 then 'DEPT OF WORKS.BUREAU OF ROADS.Region ' || cast(d.doc_id % 9 as string) else 'Office of Parks' end as dept,
  case when d.doc_id % 3 = 1 then 'The department is seeking a software system for the city of Fresno, CA and its partners. ' else '' end
  || case when d.doc_id % 5 = 1 then 'The contractor shall provide monthly status reports to the agency. The vendor must submit a form. Staff will provide training for the users of the platform. ' else '' end
  || case when d.doc_id % 9 = 2 then 'This is addendum 3 of the file. 12-34 form line of the package here. ' else '' end
  || case when d.doc_id % 10 = 3 then '' else replace(d.text, chr(10), chr(10) || chr(10)) end
  || case when d.doc_id % 7 = 0 then chr(10) || 'Scope of Work:' || chr(10) || '- Provide cloud hosting for the data of the agency' || chr(10)
       || '* Deliver support to the users in the field offices;' || chr(10) || '3) Maintain the network and the servers of the state' || chr(10)
       || 'CONTRACT TERMS' || chr(10) || '- Not part of the section but a bullet of the text' || chr(10) else '' end
  || case when d.doc_id % 8 = 1 then chr(10) || 'The system includes account creation and login, plan selection and enrollment, and nightly data exchange jobs, etc. More text.' else '' end as description,
  case d.doc_id % 3 when 0 then 'Solicitation' when 1 then '' end as event_type,
  case when d.doc_id % 2 = 0 then 'S-' || cast(d.doc_id as string) end as solicitation_number,
  case when d.doc_id % 11 = 0 then '26501 Avenue 140, Porterville, California, 93257' when d.doc_id % 11 = 1 then 'near Davis, CA' end as meeting_location,
  ARR(case d.doc_id % 4 when 0 then 'IT Service Delivery - Cloud-based software as a srvc' when 1 then '<div>x' when 2 then 'Office - Equipment maint.' else ' ' end,
      case d.doc_id % 3 when 0 then 'provide hosting mgmt' when 1 then 'Network  gear' else 'IT Service Delivery - cloud-based software as a srvc' end) as code_descriptions,
  ARR(case d.doc_id % 3 when 0 then 'SOW_final-v2.pdf' when 1 then 'Bidder Conference.pdf' else 'Map_of_site.docx' end,
      case d.doc_id % 2 when 0 then 'Exhibit A.pdf' else 'Cover letter.txt' end, 'RFP 12.docx') as labels
from {{documents}} d
"""


# Tables whose rows are dear to work on, with the source that is dealt over all tasks for it.
SPREAD = {"portal_text": "documents", "descriptions": "documents", "attachment_text": "documents", "raw_records": "orders"}


def _expand(sql: str, known: dict[str, str]) -> str:
    """Inline derived tables that `sql` names, so only base tables are left."""
    def sub(match: re.Match) -> str:
        name = match.group(1)
        return f"({_expand(known[name], known)})" if name in known else "{" + name + "}"
    return re.sub(r"\{([a-z_]\w*)\}", sub, sql)


def duck(name: str) -> str:
    """The table as a DuckDB sub-query."""
    sql = _expand(TABLES[name], TABLES)
    sql = re.sub(r"\{([a-z_]\w*)\}", r"\1", sql)
    return "(" + sql.replace("ARR(", "list_value(").replace("SHA256(", "sha256(").replace("NULLARR", "cast(null as varchar[])") + ")"


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a Spark DataFrame."""
    if name not in TABLES:
        return base(spark, sf_dir, name)
    sql = _expand(TABLES[name], TABLES)
    sources = {n: base(spark, sf_dir, n) for n in set(re.findall(r"\{([a-z_]\w*)\}", sql))}
    if name in SPREAD:
        sources[SPREAD[name]] = spread(sources[SPREAD[name]])
    spark_sql = re.sub(r"SHA256\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", sql.replace("NULLARR", "cast(null as array<string>)").replace("ARR(", "array("))
    return spark.sql(spark_sql, **sources)


def with_tables(sql: str) -> str:
    """Replace ``{name}`` in a check query by the derived table's sub-query."""
    return re.sub(r"\{([a-z_]\w*)\}", lambda m: duck(m.group(1)) if m.group(1) in TABLES else m.group(1), sql)
