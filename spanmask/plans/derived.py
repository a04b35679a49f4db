"""Derived test tables: one SQL text, run unchanged by Spark and by DuckDB.

They are built from the supplied tables so that their size follows the scale
factor; ``{customer}`` etc. are table references filled in per engine.
"""

from __future__ import annotations

# Notes with one kind of personal data each (14 templates over customer rows).
NOTES_SQL = """
select c_custkey as note_id,
  case c_custkey % 14
    when 0 then 'write to user.' || cast(c_custkey as string) || '@mail.example.com today'
    when 1 then 'call (415) 555-' || lpad(cast(c_custkey % 10000 as string), 4, '0') || ' now'
    when 2 then 'ring 9' || lpad(cast(c_custkey as string), 9, '0') || ' now'
    when 3 then 'tax id ABCDE' || lpad(cast(c_custkey % 10000 as string), 4, '0') || 'F on file'
    when 4 then 'card id 2345 6789 ' || lpad(cast(c_custkey % 10000 as string), 4, '0') || ' seen'
    when 5 then 'pay user' || cast(c_custkey as string) || '@okbank today'
    when 6 then 'host 10.' || cast(c_custkey % 256 as string) || '.0.7 is up'
    when 7 then 'token ' || md5(cast(c_custkey as string)) || ' leaked'
    when 8 then 'paid by 4111-1111-1111-' || lpad(cast(c_custkey % 10000 as string), 4, '0') || ' ok'
    when 9 then 'Plot ' || cast(c_custkey % 90 + 1 as string) || 'B, Maple Court,' || chr(10) || '2nd Main, Lakeside,' || chr(10) || 'Bengaluru ' || case when c_custkey % 3 = 0 then '560068' else '199999' end
    when 10 then 'ssn ' || lpad(cast(c_custkey % 1000 as string), 3, '0') || '-' || lpad(cast(c_custkey % 9 as string), 2, '0') || '-6789 given'
    when 11 then 'pin ' || case when c_custkey % 3 = 0 then '560068' else '199999' end || ' zip ' || lpad(cast(c_custkey % 100000 as string), 5, '0')
    when 12 then 'same span ' || lpad(cast(234567890000 + c_custkey as string), 12, '0') || ' twice'
    else 'nothing here for ' || c_mktsegment
  end as text
from {customer}
"""

# Address blocks for the labelled-form exclusion (V2): free form, free form with
# a form line below it, a labelled form, and a form keyword without a colon.
FORM_NOTES_SQL = """
select c_custkey as note_id,
  case c_custkey % 4
    when 0 then 'Flat ' || cast(c_custkey % 50 + 1 as string) || 'B, Rosewood Apartments,' || chr(10) || '4th Cross, Indiranagar,' || chr(10) || 'Bengaluru 560068'
    when 1 then 'Flat ' || cast(c_custkey % 50 + 1 as string) || 'B, Rosewood Apartments,' || chr(10) || '4th Cross, Indiranagar,' || chr(10) || 'Bengaluru 560068' || chr(10) || 'State: Karnataka'
    when 2 then 'Floor No.: ' || cast(c_custkey % 20 + 1 as string) || chr(10) || 'Building No./Flat No.: E-' || cast(c_custkey % 900 + 100 as string) || chr(10) || 'City/Town/Village: Bengaluru' || chr(10) || 'PIN Code: 560068'
    else 'Flat ' || cast(c_custkey % 50 + 1 as string) || 'B, State Bank Road,' || chr(10) || '4th Cross, Indiranagar,' || chr(10) || 'Bengaluru 560068'
  end as text
from {customer}
"""

# Documents concatenated three at a time (consecutive ids, groups doc_id div 3)
# with a paragraph break between them: paragraph packing, the oversize-paragraph
# trap and sentence packing all occur.  Spark builds it with the DataFrame API
# (plans.queries.para_docs); this is the DuckDB text of the same table.
PARA_DOCS_DUCKDB = """
select min(doc_id) as doc_id,
  string_agg(text, chr(10) || chr(10) order by doc_id) as text
from {documents}
group by doc_id // 3
"""

# Every conversation turn (variant 0), and a blank or null row beside each (V7, S3).
BLANK_CONV_SQL = """
select conv_id, turn, 0 as variant, text from {conversations}
union all
select conv_id, turn, 1 + cast(turn % 3 as int) as variant,
  case turn % 3
    when 0 then ''
    when 1 then ' ' || chr(10) || chr(9) || ' '
  end as text
from {conversations}
"""

# The fixture registry: the PIN used throughout the tests and one per customer.
REGISTRY_SQL = """
select '560068' as pin union
select cast(200000 + c_custkey * 37 % 600000 as string) as pin from {customer}
"""

# Social security numbers on both sides of each rule: areas 000, 666 and 9xx, group 00,
# serial 0000.
SSN_NOTES_SQL = """
select c_custkey as note_id,
  'ssn ' || case c_custkey % 7 when 0 then '000' when 1 then '666' when 2 then '9' || lpad(cast(c_custkey % 100 as string), 2, '0')
    else lpad(cast(c_custkey % 899 + 1 as string), 3, '0') end
  || '-' || case c_custkey % 5 when 0 then '00' else lpad(cast(c_custkey % 99 + 1 as string), 2, '0') end
  || '-' || case c_custkey % 3 when 0 then '0000' else lpad(cast(c_custkey % 9999 + 1 as string), 4, '0') end || ' given' as text
from {customer}
"""

# Letters with personal data for both layers: an IP and a phone for the regex
# layer (with only a blank between them), nation/region/segment names and two
# stopwords for the entity layer.
ENTITY_NOTES_SQL = """
select c.c_custkey as note_id,
  'Dear client, parcel for ' || n.n_name || ' (' || r.r_name || ') from 10.0.' || cast(c.c_custkey % 256 as string)
  || '.1 (415) 555-' || lpad(cast(c.c_custkey % 10000 as string), 4, '0')
  || ' for the ' || c.c_mktsegment || ' office.' as text
from {customer} c
join {nation} n on n.n_nationkey = c.c_nationkey
join {region} r on r.r_regionkey = n.n_regionkey
"""

# Dictionary of the stand-in scorer: (term, label, confidence).
ENTITY_TERMS_SQL = """
select n_name as term, 'location' as label, cast(60 + 10 * (n_nationkey % 5) as double) / 100 as confidence from {nation}
union all
select distinct split_part(r_name, ' ', 1) as term, 'city' as label, cast(80 as double) / 100 as confidence from {region}
union all
select r_name as term, 'location' as label, cast(90 as double) / 100 as confidence from {region}
union all
select distinct c_mktsegment as term, 'organization' as label, cast(70 as double) / 100 as confidence from {customer}
union all
select term, 'person' as label, cast(95 as double) / 100 as confidence
from (select 'client' as term union all select 'office' as term) s
"""

# Dictionary of the documents: the first words of their texts; most contain others of
# the texts' words, some are stopwords.
DOCUMENT_TERMS_SQL = """
select distinct term,
  case length(term) % 3 when 0 then 'person' when 1 then 'organization' else 'city' end as label,
  cast(60 + 10 * (length(term) % 5) as double) / 100 as confidence
from (select split_part(split_part(text, chr(10), 1), ' ', 1) as term from {documents}) w
where length(term) between 3 and 14
"""

# Literal entity hits on the notes (chunk-local offsets hit_start/hit_end, one
# chunk per note):
# overlapping, contained and disjoint spans, confidences on both sides of 0.75,
# stopword texts and one label outside the label set.
ENTITY_HITS_SQL = """
select note_id, 0 as chunk_idx, 0 as hit_idx, 0 as hit_start, instr(text, ' ') - 1 as hit_end, 'person' as label,
  substr(text, 1, instr(text, ' ') - 1) as text, cast(note_id % 100 as double) / 100 as confidence from {notes}
union all
select note_id, 0, 1, 2, 9, 'organization', substr(text, 3, 7), cast((note_id + 37) % 100 as double) / 100 from {notes}
union all
select note_id, 0, 2, 5, 8, 'city', substr(text, 6, 3), cast((note_id + 71) % 100 as double) / 100 from {notes}
union all
select note_id, 0, 3, 3, 12, 'iban', substr(text, 4, 9), cast((note_id + 13) % 100 as double) / 100 from {notes}
union all
select note_id, 0, 4, 0, 4, 'email', substr(text, 1, 4), cast(99 as double) / 100 from {notes}
union all
select note_id, 0, 5, 9, 14, 'person', case note_id % 4 when 0 then 'Client' || chr(10) when 1 then chr(9) || 'pin ' when 2 then chr(160) || 'OFFICE' else chr(160) || 'ann' end,
  cast(90 as double) / 100 from {notes}
"""
