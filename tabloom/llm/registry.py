"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from tabloom.llm.decontaminate import op5_latent_decontamination
from tabloom.llm.html_extract import op2_html_text
from tabloom.llm.language_id import op10_language_id
from tabloom.llm.lattice_lm import op8_lattice_lm
from tabloom.llm.mixing import op9_pareto_mixing
from tabloom.llm.permutation_index import op1_permutation_index
from tabloom.llm.sharding import op7_sharding
from tabloom.llm.simhash import op6_simhash_golay
from tabloom.llm.url_filter import op3_url_templates
from tabloom.llm.warc import op4_warc

QUERIES = {f.__name__: f for f in (op1_permutation_index, op2_html_text, op3_url_templates, op4_warc, op5_latent_decontamination, op6_simhash_golay, op7_sharding, op8_lattice_lm, op9_pareto_mixing, op10_language_id)}

#: op4's result is fixed by its contract. The other operators' results rest on hashes, searches or
#: models that SQL lacks or has in another form. tests/llm hold them against brute force: op1's exact
#: neighbours, op2's templates, op3's rules and templates, op5's windows, op6's and the pipeline's
#: groups, op7's ranks, op8's counts and scores, op9's whole mix; op10 by held-out accuracy.
SQL = {
    "op4_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, url, strlen(h)::BIGINT AS n, sha1(h) AS s FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY n, s) AS top FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to,
       url AS target_uri, 'urn:capture:' || page_id || ':' || s AS record_id
FROM m""",
}
