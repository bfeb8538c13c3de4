"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def mix_sql(table: str, seed: int = 0) -> str:
    """One row per document of the mix plan, with ``times`` and the other columns of the table."""
    return rf"""
    WITH sized AS (
        SELECT *, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
            ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
        FROM {table}
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
            list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1) AS weight
        FROM sized GROUP BY source
    ), ordered AS (
        SELECT *, source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS wanted, sum(weight) OVER () AS weights,
            coalesce(sum(source_size * 2.0::DOUBLE) OVER up, 0.0) AS cap_before, coalesce(sum(weight) OVER up, 0.0) AS weight_before
        FROM sources
        WINDOW up AS (ORDER BY source_size * 2.0::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), marked AS (
        SELECT *, cap <= weight * ((wanted - cap_before) / (weights - weight_before)) AS capped FROM ordered
    ), levels AS (
        SELECT *, sum(CASE WHEN capped THEN cap ELSE 0.0::DOUBLE END) OVER () AS cap_sum,
            sum(CASE WHEN capped THEN weight ELSE 0.0::DOUBLE END) OVER () AS weight_sum FROM marked
    ), targets AS (
        SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * ((wanted - cap_sum) / (weights - weight_sum)) END AS target
        FROM levels
    ), parted AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
    ), placed AS (
        SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
            sum(s.size) OVER (PARTITION BY s.source, s.hash, s.doc_id, s.size) AS peers,
            sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.doc_id NULLS FIRST, s.size RANGE UNBOUNDED PRECEDING) AS upto
        FROM sized s JOIN parted p ON s.source IS NOT DISTINCT FROM p.source
    )
    SELECT * EXCLUDE (hash, whole, rest, peers, upto),
        (whole + CASE WHEN source_size > 0 AND upto - peers + peers / 2.0 <= rest THEN 1 ELSE 0 END)::INT AS times
    FROM placed
    """


def quality_sql(table: str, reach: float = 3.0, least_group: int = 200) -> str:
    """The table's columns with the counts, ``base_failed`` and ``kept``."""
    measures = {
        "symbols_per_word": ("n_symbols", "n_words", 0.1, False),
        "dup_line_share": ("n_dup_lines", "n_lines", 0.25, False),
        "repeat_share": ("n_repeat_words", "n_words", 0.2, False),
        "upper_share": ("n_upper", "word_chars", 0.2, False),
        "word_length": ("word_chars", "n_words", 2.0, True),
    }
    least = " ".join(f"WHEN '{k}' THEN {v[2]}" for k, v in measures.items())
    two = " OR ".join(f"k = '{k}'" for k, v in measures.items() if v[3])
    long = " UNION ALL ".join(
        f"SELECT rid, lang, source, '{k}' AS k, CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END AS x FROM judged WHERE NOT base_failed"
        for k, (a, b, _, _) in measures.items()
    )
    return rf"""
    WITH docs AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS whole FROM {table}
    ), listed AS (
        SELECT *, regexp_extract_all(whole, '{WORD}') AS words,
            list_filter(string_split(whole, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs
    ), spread AS (
        SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM listed
    ), windows AS (
        SELECT rid, p, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM spread WINDOW o AS (PARTITION BY rid ORDER BY p)
    ), twice AS (
        SELECT rid, p, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1 AS again FROM windows
    ), covered AS (
        SELECT rid, again OR coalesce(lag(again) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS hit
        FROM twice WINDOW o AS (PARTITION BY rid ORDER BY p)
    ), repeats AS (
        SELECT rid, count(*) FILTER (WHERE hit) AS n FROM covered GROUP BY rid
    ), counted AS (
        SELECT l.* EXCLUDE (whole, words, lines), len(words)::BIGINT AS n_words, len(list_aggregate(words, 'string_agg', '')) AS wc,
            len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
            len(regexp_extract_all(whole, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(whole, '\p{{Lu}}'))::BIGINT AS n_upper,
            coalesce(r.n, 0)::BIGINT AS n_repeat_words
        FROM listed l LEFT JOIN repeats r USING (rid)
    ), judged AS (
        SELECT * EXCLUDE (wc), coalesce(wc, 0)::BIGINT AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
    ), long AS ({long}
    ), grouped AS (
        SELECT rid, k, x, count(*) OVER (PARTITION BY k, lang, source) AS n_own, count(*) OVER (PARTITION BY k, lang) AS n_lang,
            count(*) OVER (PARTITION BY k) AS n_all,
            row_number() OVER (PARTITION BY k, lang, source ORDER BY x) AS r_own,
            row_number() OVER (PARTITION BY k, lang ORDER BY x) AS r_lang, row_number() OVER (PARTITION BY k ORDER BY x) AS r_all,
            lang, source
        FROM long
    ), levels AS (
        SELECT lang, source, true AS by_source, true AS by_lang, k, max(n_own) AS n, min(x) FILTER (WHERE r_own >= 0.25 * n_own) AS lo, min(x) FILTER (WHERE r_own >= 0.75 * n_own) AS hi
        FROM grouped GROUP BY lang, source, k
    ), by_lang AS (
        SELECT lang, k, max(n_lang) AS n, min(x) FILTER (WHERE r_lang >= 0.25 * n_lang) AS lo, min(x) FILTER (WHERE r_lang >= 0.75 * n_lang) AS hi
        FROM grouped GROUP BY lang, k
    ), by_all AS (
        SELECT k, min(x) FILTER (WHERE r_all >= 0.25 * n_all) AS lo, min(x) FILTER (WHERE r_all >= 0.75 * n_all) AS hi FROM grouped GROUP BY k
    ), chosen AS (
        SELECT o.lang, o.source, o.k,
            CASE WHEN o.n >= {least_group} THEN o.lo WHEN l.n >= {least_group} THEN l.lo ELSE a.lo END AS lo,
            CASE WHEN o.n >= {least_group} THEN o.hi WHEN l.n >= {least_group} THEN l.hi ELSE a.hi END AS hi
        FROM levels o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.k = l.k JOIN by_all a ON o.k = a.k
    ), fences AS (
        SELECT *, greatest({reach} * (hi - lo), CASE k {least} END) AS far FROM chosen
    ), broken AS (
        SELECT DISTINCT g.rid FROM grouped g JOIN fences f
            ON g.lang IS NOT DISTINCT FROM f.lang AND g.source IS NOT DISTINCT FROM f.source AND g.k = f.k
        WHERE NOT coalesce(g.x <= f.hi + f.far, true) OR (({two.replace("k =", "g.k =")}) AND NOT coalesce(g.x >= f.lo - f.far, true))
    )
    SELECT j.*, NOT j.base_failed AND b.rid IS NULL AS kept FROM judged j LEFT JOIN broken b USING (rid)
    """


def filter_audit_sql(docs: str, labels: str) -> str:
    """One row per part, order of the five filters and step, found by running every order over the documents."""
    letters = "(SELECT unnest(string_split('ABCDE', '')) AS f)"
    return rf"""
    WITH texts AS (
        SELECT doc_id, coalesce(doc_id, {(1 << 63) - 1}) AS rank, coalesce(text, '') AS text, coalesce(source, '') AS part,
            regexp_extract_all(coalesce(text, ''), '{WORD}') AS words
        FROM {docs}
    ), copies AS (SELECT text, min(rank) AS least FROM texts GROUP BY text
    ), said AS (
        SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
        FROM {labels} WHERE doc_id IS NOT NULL GROUP BY doc_id
    ), judged AS (
        SELECT t.part, coalesce(s.good, false) AS good, coalesce(s.toxic, false) AS toxic,
            (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
            || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
            || (CASE WHEN 100 * len(regexp_extract_all(t.text, '[A-Z]')) > 2 * length(t.text) THEN 'C' ELSE '' END)
            || (CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END)
            || (CASE WHEN t.rank > c.least THEN 'E' ELSE '' END) AS fails
        FROM texts t JOIN copies c ON t.text = c.text LEFT JOIN said s ON t.doc_id = s.doc_id
    ), cells AS (
        SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
        FROM judged GROUP BY part, fails
    ), orders AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
        FROM {letters} a, {letters} b, {letters} c, {letters} d, {letters} e
        WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
    ), steps AS (
        SELECT filter_order, step::INT AS step, filter_order[step] AS f, filter_order[1 : step - 1] AS before
        FROM orders, generate_series(1, 5) s(step)
    ), told AS (
        SELECT part, filter_order, step, f, fails, n, n_good, n_toxic, contains(fails, f) AS bad,
            len(translate(fails, before, '')) < len(fails) AS gone
        FROM cells, steps
    ), summed AS (
        SELECT part, filter_order, step, f,
            coalesce(sum(n) FILTER (WHERE NOT bad AND NOT gone), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (WHERE bad AND gone), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
            coalesce(sum(n_good) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS good_lost,
            coalesce(sum(n_toxic) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS toxic_lost
        FROM told GROUP BY part, filter_order, step, f
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
    FROM summed
    """


SQL = {
    "op1_mix": f"SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * times)::BIGINT AS taken FROM ({mix_sql('documents')})",
    "op7_quality": f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
        FROM ({quality_sql('documents')})""",
    "op12_filter_audit": filter_audit_sql("documents", "labels"),
}
