"""Longer SQL twins of the registered queries."""

COLLOCATIONS = r"""
    WITH texts AS (
        SELECT coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    ), pieces AS (
        SELECT lang, row_number() OVER () AS nr, piece
        FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)
    ), worded AS (
        SELECT lang, nr, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda w: w <> '') AS w FROM pieces
    ), words AS (
        SELECT lang, nr, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM worded
    ), runs AS (
        SELECT lang, w1, lead(w1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3 FROM words
        WINDOW piece AS (PARTITION BY nr ORDER BY i)
    ), grams AS (
        SELECT lang, 1 AS m, [w1] AS p FROM runs
        UNION ALL SELECT lang, 2, [w1, w2] FROM runs WHERE w2 IS NOT NULL
        UNION ALL SELECT lang, 3, [w1, w2, w3] FROM runs WHERE w3 IS NOT NULL
    ), counted AS (
        SELECT lang, m, p, array_to_string(p, ' ') AS phrase, count(*) AS f FROM grams GROUP BY lang, m, p
    ), totals AS (
        SELECT lang, sum(f) AS n FROM counted WHERE m = 1 GROUP BY lang
    ), candidates AS (
        SELECT lang, m, phrase, p, f AS a FROM counted WHERE m > 1 AND f >= 10
    ), parts AS (
        SELECT lang, phrase, a, 1 AS k, p[1] AS head, array_to_string(p[2:], ' ') AS rest FROM candidates
        UNION ALL
        SELECT lang, phrase, a, 2, array_to_string(p[:2], ' '), p[3] FROM candidates WHERE m = 3
    ), cuts AS (
        SELECT s.lang, s.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
        FROM parts s
        JOIN counted x ON x.lang = s.lang AND x.phrase = s.head
        JOIN counted y ON y.lang = s.lang AND y.phrase = s.rest
    ), lowest AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), inner_parts AS (
        SELECT lang, a AS longer, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase
        FROM candidates WHERE m = 3
    ), covered AS (
        SELECT lang, phrase, max(longer) AS longer FROM inner_parts GROUP BY lang, phrase
    ), kept AS (
        SELECT s.* FROM lowest s LEFT JOIN covered USING (lang, phrase)
        WHERE len(string_split(phrase, ' ')) > 2 OR longer IS NULL OR 100 * longer < 50 * a
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
    )
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
    FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

LICENSE_BASE = r"""
    WITH texts AS (
        SELECT row_number() OVER () AS nr, doc_id,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    ), split AS (
        SELECT nr, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
    ), words AS (
        SELECT nr, unnest(w) AS w1, generate_subscripts(w, 1) - 1 AS place FROM split
    ), runs AS (
        SELECT nr, place, w1, lead(w1) OVER t AS w2, lead(w1, 2) OVER t AS w3, lead(w1, 3) OVER t AS w4 FROM words
        WINDOW t AS (PARTITION BY nr ORDER BY place)
    ), places AS (
        SELECT nr, place, 'mit' AS label FROM runs WHERE w1 = 'under' AND w2 = 'the' AND w3 = 'mit' AND w4 = 'license'
        UNION ALL
        SELECT nr, place, 'apache-2' FROM runs WHERE w1 = 'apache' AND w2 = 'license' AND w3 = 'version' AND w4 = '2'
        UNION ALL
        SELECT nr, place, 'cc-by-nc' FROM runs WHERE w1 = 'cc' AND w2 = 'by' AND w3 = 'nc'
    ), found AS (
        SELECT nr, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
               array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels
        FROM places GROUP BY nr
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base,
           coalesce(first_word, -1) AS first_word, coalesce(last_word, -1) AS last_word,
           coalesce(base_labels, '') AS base_labels
    FROM split LEFT JOIN found USING (nr)
"""

PERSONAL_DATA_COUNTS = r"""
    WITH found AS (
        SELECT doc_id,
               regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS emails,
               regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS ips,
               list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards,
               list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phones
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    )
    SELECT doc_id, len(emails) AS n_email,
           len(list_filter(ips, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::HUGEINT)) <= 255)) AS n_ip,
           len(list_filter(cards, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(x) + 1),
               lambda i: CASE WHEN i % 2 = 1 THEN x[length(x) - i + 1]::INT
                              WHEN x[length(x) - i + 1]::INT > 4 THEN 2 * x[length(x) - i + 1]::INT - 9
                              ELSE 2 * x[length(x) - i + 1]::INT END)) % 10 = 0)) AS n_card,
           len(list_filter(phones, lambda x: length(x) BETWEEN 10 AND 15)) AS n_phone
    FROM found
"""

MIXING_TARGETS = r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
    ), sources AS (
        SELECT source, sum(size) AS s,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
        FROM sized GROUP BY source
    ), ordered AS (
        SELECT *, 2.0 * s / weight AS full_at, row_number() OVER (ORDER BY 2.0 * s / weight, source NULLS LAST) AS k FROM sources
    ), levels AS (
        SELECT full_at, k, (1.5 * sum(s) OVER () - coalesce(sum(2 * s) OVER before, 0)) / sum(weight) OVER after AS level
        FROM ordered
        WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               after AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ), level AS (
        SELECT arg_min(level, k) AS level FROM levels WHERE level <= full_at
    )
    SELECT doc_id, size, s::BIGINT AS source_size, round(least(2.0 * s, level.level * weight), 6) AS target
    FROM sized JOIN ordered ON sized.source IS NOT DISTINCT FROM ordered.source, level
"""
