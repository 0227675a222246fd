"""The name census (C1-C6, P11, X7, X8, X22): evidence, classes, drops and overrides of names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import census as C
from .base import query, table

c = F.col
Q = "chr(39)"
#: Names of every kind that a rule knows, from the parts' own words; the same text serves both engines.
NOUN, GENUS = "split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 1)"
KINDS = (
    "'sp.'", "'12'", f"{NOUN} || '?'", f"'undescribed ' || {NOUN}", f"'cf. ' || {NOUN}", f"{NOUN} || '_or_boltensis'", f"{NOUN} || ' sp.'", f"'taxonomy:binomial=' || {NOUN}", f"'7-' || {NOUN}", f"{NOUN} || ' virus'",
    f"{NOUN} || ' x alba'", f"'x ' || {NOUN}", f"'×' || {NOUN}", "lower(p_type)", f"{NOUN} || ' ' || lower(p_type)", f"{NOUN} || ' müll.'", f"{NOUN} || ' ex auratus'", f"{NOUN} || '-'", f"'d' || {Q} || 'orbigny'", f"{NOUN} || ' (l.)'",
    f"{NOUN} || '_b'", f"{NOUN} || {Q}", f"{NOUN} || ' group'", f"{NOUN} || ' ' || {Q} || 'gold' || {Q}", f"{NOUN} || ' ssp. minor'", f"{NOUN} || ' minor'", f"{NOUN} || ' minor alba'", f"{NOUN} || ' brandx7'", "'unknown'", f"'subg. ' || {NOUN}",
    f"{Q} || {NOUN} || {Q}", "'- gold'", f"{NOUN} || ' auratus l.'", "'morph a'", f"'sp. ' || {NOUN} || 'ensis'", "'sp. tag9'", f"{NOUN} || ' prob.'", f"{NOUN} || ' = ' || 'alba'", "'économy'", f"{NOUN} || 'ensis.'",
    f"{NOUN} || ' weldon'", f"'auratus weldon'", f"'minor weldon'", f"'alba weldon'", f"'nova weldon'", f"'rubra weldon'", f"'taxonomy:x ' || {NOUN} || 'ata'", "'müll.'", NOUN, "NULL",
)
EPITHET = "CASE p_partkey % 50 " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(KINDS)) + " END"
SPLIT, KINGDOM = "CASE WHEN p_partkey % 20 = 7 THEN 'val' ELSE 'train' END", "CASE WHEN p_size % 2 = 0 THEN 'plants' ELSE 'animals' END"
RANK = "CASE WHEN p_partkey % 3 = 0 THEN 'genus' ELSE 'species' END"
TAXON = f"CASE WHEN p_partkey % 3 = 0 THEN {GENUS} WHEN p_partkey % 5 = 0 THEN p_name || 'ensis ' || lower(p_type) ELSE p_name END"
AUTHORITY = f"CASE p_partkey % 4 WHEN 0 THEN '(' || p_type || ', ' || (1700 + p_size) || ')' WHEN 1 THEN 'J. Müll.Arg. & Weldon ' WHEN 2 THEN 'd’Orbigny; L.' END"
#: Answers of a name service that a cache holds: for some names, and the authorship of genera.
ANSWER = f"CASE WHEN p_partkey % 50 IN (13, 48) THEN {GENUS} || ' ' || {EPITHET} END"


def sql_fold(x: str) -> str:
    return f"lower(strip_accents(translate({x}, '’‘', '''''')))"


def sql_list(names) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


BASE = f"""names AS (SELECT p_partkey, {GENUS} AS genus, {EPITHET} AS epithet, {SPLIT} AS split, {KINGDOM} AS kingdom FROM part),
taxa AS (SELECT {RANK} AS rank, {TAXON} AS name, {AUTHORITY} AS authority FROM part),
base AS (SELECT rank, name, list_filter(string_split(regexp_replace(regexp_replace(translate(lower(authority), '’‘', ''''''), '\\d+', ' ', 'g'), '[()\\[\\],;&:"]', ' ', 'g'), ' '), lambda t: t <> '') AS t FROM taxa WHERE authority IS NOT NULL),
au AS (SELECT rank, name, list_distinct(list_transform(list_concat(list_concat(t,
    flatten(list_transform(list_filter(t, lambda x: regexp_matches(x, '\\.[^.]')), lambda x: list_transform(list_filter(string_split(x, '.'), lambda y: y <> ''), lambda y: y || '.')))),
    flatten(list_transform(list_filter(t, lambda x: contains(x, '''')), lambda x: list_filter(string_split(x, ''''), lambda y: length(y) > 1)))), lambda x: {sql_fold('x')})) AS tokens FROM base),
authors AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM au) GROUP BY 1),
genus_authors AS (SELECT DISTINCT {sql_fold('name')} AS genus, unnest(tokens) AS token FROM au WHERE rank = 'genus'),
cn AS (SELECT string_split(lower(name), ' ') AS w FROM taxa WHERE contains(name, ' ')),
epithets AS (SELECT {sql_fold('e')} AS token, count(*) AS n FROM (SELECT unnest(w[2:]) AS e FROM cn) WHERE e <> '' GROUP BY 1),
binomials AS (SELECT DISTINCT {sql_fold("array_to_string(w[:2], ' ')")} AS name FROM cn),
trinomials AS (SELECT DISTINCT {sql_fold("array_to_string(w[:3], ' ')")} AS name FROM cn WHERE len(w) >= 3),
sfx AS (SELECT w[-1] AS suffix, count(*) AS n_epithets, count(DISTINCT w[1]) AS n_first FROM (SELECT DISTINCT string_split(epithet, ' ') AS w FROM names WHERE contains(epithet, ' ')) GROUP BY 1),
words AS (SELECT genus, s, raw, g, CASE WHEN raw[1] IN ('x', '×') AND len(raw) >= 2 THEN list_concat(['×' || raw[2]], raw[3:]) ELSE raw END AS toks, (raw[1] IN ('x', '×') AND len(raw) >= 2) OR starts_with(raw[1], '×') AS hybrid
  FROM (SELECT DISTINCT genus, epithet AS s, string_split(epithet, ' ') AS raw, {sql_fold('genus')} AS g FROM names WHERE epithet IS NOT NULL)),
tok AS (SELECT genus, s, g, size, pos, t, {sql_fold('t')} AS ft FROM (SELECT genus, s, g, size, pos, CASE WHEN pos = 0 THEN ltrim(w, '×') ELSE w END AS t FROM (SELECT genus, s, g, len(toks) AS size, unnest(toks) AS w, unnest(range(len(toks))) AS pos FROM words)) WHERE pos > 0 OR t <> ''),
seen AS (SELECT tok.*, coalesce(a.n, 0) AS ac, coalesce(e.n, 0) AS ec, x.token IS NOT NULL AS ga, b.name IS NOT NULL AS bi, n_first FROM tok
  LEFT JOIN authors a ON a.token = ft LEFT JOIN epithets e ON e.token = ft LEFT JOIN genus_authors x ON x.genus = g AND x.token = ft LEFT JOIN binomials b ON b.name = g || ' ' || ft LEFT JOIN sfx ON suffix = t),
why AS (SELECT genus, s, pos, CASE WHEN regexp_matches(t, '\\d') THEN 'digit' WHEN regexp_matches(t, '[()\\[\\]&,;]') THEN 'punctuation' WHEN pos >= 1 AND t IN {sql_list(C.CONNECT)} THEN 'author_connector'
  WHEN ends_with(t, '-') AND length(t) > 1 THEN 'truncated_author' WHEN contains(ft, '''') AND NOT (starts_with(t, '''') OR ends_with(t, '''')) THEN 'apostrophe_name' WHEN contains(t, '.') AND t NOT IN {sql_list(C.DOTTED)} THEN 'abbreviation'
  WHEN ga AND (pos >= 1 OR NOT bi) THEN 'genus_authority' WHEN ac >= 2 AND ec = 0 AND (pos >= 1 OR NOT bi) THEN 'author_name' WHEN pos >= 1 AND ac >= 5 AND ac >= 20 * ec THEN 'author_name_mostly'
  WHEN pos >= 1 AND pos = size - 1 AND ((n_first >= 3 AND ac >= 1 AND ac >= ec) OR (n_first >= 5 AND ec <= 2)) THEN 'author_name_catalog_suffix' END AS reason FROM seen),
hit AS (SELECT genus, s, min(pos) AS pos, arg_min(reason, pos) AS reason FROM why WHERE reason IS NOT NULL GROUP BY ALL),
ruled AS (SELECT words.*, hit.pos, hit.reason, list_filter(list_transform(toks[2:], lambda t: CASE {' '.join(f"WHEN t = '{k}' THEN '{v}'" for k, v in C.O_MARK.items())} WHEN starts_with(t, '''') OR ends_with(t, '''') THEN 'cultivar' END), lambda x: x IS NOT NULL)[1] AS mark,
  len(list_filter(toks, lambda t: NOT regexp_full_match(ltrim(t, '×'), '\\p{{L}}+(-\\p{{L}}+)*'))) = 0 AS plain FROM words LEFT JOIN hit ON hit.genus = words.genus AND hit.s = words.s),
kind AS (SELECT *, CASE WHEN s IN {sql_list(C.PH_WHOLE)} THEN 'P:bare_token' WHEN regexp_full_match(s, '\\d+') THEN 'P:bare_number' WHEN contains(s, '?') THEN 'P:question_mark'
  WHEN regexp_matches(s, '^(undescribed|undefined)') OR s IN {sql_list(C.UNKNOWN_WORDS)} THEN 'P:undescribed_or_undefined' WHEN raw[1] IN {sql_list(C.P_LEAD)} OR starts_with(s, '''') OR starts_with(s, '- ') THEN 'P:qualified_or_rank_marker'
  WHEN contains(s, '_or_') OR contains(s, ' or ') THEN 'P:either_or' WHEN len(list_filter(raw[2:], lambda t: t IN {sql_list(C.P_INNER)})) > 0 THEN 'P:inner_sp_or_prob' WHEN regexp_matches(s, '(taxonomy|geo):') THEN 'O:machine_tag'
  WHEN regexp_full_match(s, '\\d+-[a-z]+') THEN 'O:numeral_epithet' WHEN regexp_matches(s, 'virus|viroid|phytoplasma') OR len(list_filter(raw, lambda t: t IN ('strain', 'pv.', 'bv.'))) > 0 THEN 'O:strain_or_virus'
  WHEN list_contains(raw, '=') OR contains(s, '_x_') OR len(list_filter(raw[2:-2], lambda t: t IN ('x', '×'))) > 0 OR (len(raw) >= 3 AND raw[-1] IN ('x', '×')) THEN 'O:hybrid_formula'
  WHEN pos = 0 AND len(toks) = 1 THEN 'A:author_only_single' WHEN pos = 0 THEN 'A:author_only_multi' WHEN pos > 0 THEN 'A:epithet_plus_author'
  WHEN len(toks) = 1 THEN CASE WHEN contains(s, '_') THEN 'O:underscore_label' WHEN contains(s, '''') THEN 'O:stray_quote' WHEN hybrid THEN 'C:hybrid_nothospecies' ELSE 'C:single_word' END
  WHEN mark IS NOT NULL THEN 'O:' || mark WHEN len(list_filter(toks[2:], lambda t: t IN {sql_list(C.S_MARK)})) > 0 THEN 'S:with_rank_marker' WHEN plain AND len(toks) = 2 THEN 'S:two_words' WHEN plain THEN 'O:three_plus_plain_words' ELSE 'O:other' END AS k FROM ruled),
cls AS (SELECT genus, s AS epithet, split_part(k, ':', 1) AS category, split_part(k, ':', 2) AS subtype, CASE WHEN k LIKE 'A:%' THEN reason END AS reason,
  hybrid AND k NOT IN ('P:bare_token', 'P:bare_number', 'P:question_mark', 'P:undescribed_or_undefined', 'P:qualified_or_rank_marker', 'P:either_or', 'P:inner_sp_or_prob', 'O:machine_tag', 'O:numeral_epithet', 'O:hybrid_formula')
    AND NOT (regexp_matches(s, 'virus|viroid|phytoplasma') OR len(list_filter(raw, lambda t: t IN ('strain', 'pv.', 'bv.'))) > 0) AS hybrid,
  CASE WHEN k = 'A:epithet_plus_author' THEN array_to_string(toks[:pos], ' ') END AS epithet_part FROM kind)"""


def names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(GENUS).alias("genus"), F.expr(EPITHET).alias("epithet"), F.expr(SPLIT).alias("split"), F.expr(KINGDOM).alias("kingdom"))


def evidence(spark, d) -> C.Evidence:
    taxa = table(spark, d, "part").select(F.expr(RANK).alias("rank"), F.expr(TAXON).alias("name"), F.expr(AUTHORITY).alias("authority"))
    return C.evidence(taxa, "rank", "name", "authority")


def classes(spark, d):
    rows = names(spark, d)
    return C.classified(rows, "genus", "epithet", evidence(spark, d), C.suffix_evidence(rows, "epithet"))


@query("x07_words", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(lower(p_type || '_OR_' || p_name || ' (×alba), *minor?-'), '_or_', ' '), ' '), lambda w: ltrim(regexp_replace(w, '^[.,;:?!*\"''()\\[\\]=-]+|[.,;:?!*\"''()\\[\\]=-]+$', '', 'g'), '×')), lambda w: w <> ''), '|') AS words FROM part")
def x07(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(X.words(F.concat("p_type", F.lit("_OR_"), "p_name", F.lit(" (×alba), *minor?-"))), "|").alias("words"))


@query("x08_author_tokens", f"WITH {BASE}, s AS (SELECT s_suppkey, string_split(regexp_replace(regexp_replace(lower(s_name || ' & L.Barb.Rodr. d''Or, 1758: in'), '\\d+', ' ', 'g'), '[()\\[\\],;&:\"]', ' ', 'g'), ' ') AS t FROM supplier) SELECT DISTINCT s_suppkey, unnest(list_filter(list_concat(t, ['l.', 'barb.', 'rodr.', 'or']), lambda x: x <> '')) AS w FROM s")
def x08(spark, d):
    """Dotted tokens also give their dotted parts, quoted ones their parts of two characters or more."""
    s = F.concat("s_name", F.lit(" & L.Barb.Rodr. d'Or, 1758: in"))
    return table(spark, d, "supplier").select("s_suppkey", F.explode(C.author_tokens(s)).alias("w"))


@query("x22_placeholders", f"WITH {BASE} SELECT count(*) FILTER (WHERE epithet IN {sql_list(C.PH_WHOLE)}) AS whole, count(*) FILTER (WHERE split_part(epithet, ' ', 1) IN {sql_list(C.P_LEAD)}) AS leading, count(*) FILTER (WHERE len(list_filter(string_split(epithet, ' ')[2:], lambda t: t IN {sql_list(C.P_INNER)})) > 0) AS inside FROM names")
def x22(spark, d):
    w = F.split("epithet", " ")
    return names(spark, d).agg(F.count_if(c("epithet").isin(*C.PH_WHOLE)).alias("whole"), F.count_if(F.get(w, F.lit(0)).isin(*C.P_LEAD)).alias("leading"), F.count_if(F.exists(F.slice(w, F.lit(2), F.size(w)), lambda t: t.isin(*C.P_INNER))).alias("inside"))


@query("c01_name_classifier", f"WITH {BASE} SELECT * FROM cls")
def c01(spark, d):
    return classes(spark, d)


@query("c02_author_reason", f"WITH {BASE} SELECT genus, s AS epithet, CAST(pos AS INT) AS pos, reason FROM hit")
def c02(spark, d):
    rows = names(spark, d)
    return C.author_reasons(rows, "genus", "epithet", evidence(spark, d), C.suffix_evidence(rows, "epithet"))


@query("c03_token_evidence", f"WITH {BASE} SELECT 'author' AS kind, token AS name, n FROM authors UNION ALL SELECT 'epithet', token, n FROM epithets UNION ALL SELECT 'genus author', genus || ' ' || token, 1 FROM genus_authors UNION ALL SELECT 'binomial', name, 1 FROM binomials UNION ALL SELECT 'trinomial', name, 1 FROM trinomials")
def c03(spark, d):
    ev, one = evidence(spark, d), F.lit(1).cast("long").alias("n")
    parts = (ev.authors.select(F.lit("author").alias("kind"), c("token").alias("name"), "n"), ev.epithets.select(F.lit("epithet"), "token", "n"), ev.genus_authors.select(F.lit("genus author"), F.concat_ws(" ", "genus", "token"), one), ev.binomials.select(F.lit("binomial"), "name", one), ev.trinomials.select(F.lit("trinomial"), "name", one))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query("c04_suffix_evidence", f"WITH {BASE} SELECT * FROM sfx")
def c04(spark, d):
    return C.suffix_evidence(names(spark, d), "epithet")


LIKE = f"(w.bare NOT IN {sql_list(C.PLACEHOLDERS)} AND length(w.bare) >= 3 AND regexp_full_match(w.bare, '[a-zà-ÿ][a-zà-ÿ-]*') AND NOT (coalesce(ab.n, 0) >= 1 AND (coalesce(eb.n, 0) = 0 OR coalesce(ab.n, 0) >= 5 * (coalesce(eb.n, 0) + 1))))"


@query(
    "c05_reason_to_drop",
    f"""WITH {BASE}, sp AS (SELECT DISTINCT w[1] AS genus, w[2] AS word FROM cn),
wd AS (SELECT genus, epithet, category, subtype, unnest(range(len(ws))) AS place, unnest(ws) AS t FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(replace(lower(CASE WHEN subtype = 'machine_tag' THEN regexp_replace(epithet, 'taxonomy:\\S+|geo:\\S+', ' ', 'g') ELSE epithet END), '_or_', ' '), '\\s+'), lambda x: ltrim(regexp_replace(x, '^[.,;:?!*"''()\\[\\]=-]+|[.,;:?!*"''()\\[\\]=-]+$', '', 'g'), '×')), lambda x: x <> '') AS ws FROM cls)
  UNION ALL SELECT genus, epithet, category, subtype, -1, rtrim(epithet, '.') FROM cls),
w AS (SELECT *, regexp_replace(t, '^\\d+-', '') AS bare FROM wd),
f AS (SELECT w.genus, w.epithet, w.category, w.subtype,
    coalesce(bool_or(place = -1 AND {LIKE} AND (coalesce(e.n, 0) >= 1 OR (coalesce(a.n, 0) = 0 AND length(t) >= 5 AND regexp_matches(t, '^.{{2,}}({C.LATIN_ENDINGS})$')))), false) AS stray,
    coalesce(bool_or(place >= 0 AND {LIKE}), false) AS some_like, coalesce(bool_and({LIKE}) FILTER (WHERE place >= 0), false) AS all_like, coalesce(bool_or(place = 0 AND {LIKE} AND e.n >= 1), false) AS first_used,
    coalesce(bool_or(place >= 1 AND {LIKE} AND e.n >= 1 AND regexp_matches(t, '^.{{2,}}({C.LATIN_ENDINGS})$')), false) AS later_latin, coalesce(bool_or(place >= 0 AND sp.word IS NOT NULL), false) AS known
  FROM w LEFT JOIN authors ab ON ab.token = bare LEFT JOIN epithets eb ON eb.token = bare LEFT JOIN epithets e ON e.token = t LEFT JOIN authors a ON a.token = t LEFT JOIN sp ON sp.genus = lower(w.genus) AND sp.word = t GROUP BY ALL),
h AS (SELECT *, contains(epithet, ' ') AS multi, lower(trim(split_part(epithet, ' ', 1), '.')) AS head FROM f)
SELECT genus, epithet, category, subtype, CASE WHEN category = 'C' THEN NULL
  WHEN subtype = 'author_only_single' THEN CASE WHEN ends_with(epithet, '.') AND stray THEN NULL ELSE 'single-word author name' END
  WHEN subtype = 'machine_tag' THEN CASE WHEN some_like THEN NULL ELSE 'machine tag only' END
  WHEN NOT multi THEN CASE WHEN category = 'P' AND NOT ((subtype = 'either_or' AND some_like) OR (contains(epithet, '?') AND all_like) OR (starts_with(epithet, '''') AND first_used)) THEN 'single-word placeholder' END
  WHEN head IN {sql_list(C.RANK_WORDS)} THEN 'subgenus, section or series label'
  WHEN subtype = 'author_only_multi' THEN CASE WHEN known THEN NULL ELSE 'author-only string' END
  WHEN category = 'P' THEN CASE WHEN head IN ('cf', 'aff', 'nr', 'near') THEN NULL WHEN head IN ('sp', 'spp') THEN CASE WHEN later_latin THEN NULL ELSE 'sp. plus a tag or locality' END
    WHEN head IN ('morph', 'cv') OR starts_with(epithet, '- ') OR starts_with(epithet, '''') THEN 'morph label, cultivar marker or cultivar name' END END AS reason_to_drop FROM h""",
)
def c05(spark, d):
    ev, rows = evidence(spark, d), names(spark, d)
    species = ev.binomials.select(F.split_part("name", F.lit(" "), F.lit(1)).alias("genus"), F.split_part("name", F.lit(" "), F.lit(2)).alias("word"))
    return C.drop_reasons(C.classified(rows, "genus", "epithet", ev, C.suffix_evidence(rows, "epithet")), ev.tokens, species)


ANSWERS = f"""answers AS (SELECT {ANSWER} AS name, NULL::VARCHAR AS rank, {KINGDOM} AS kingdom, CASE WHEN p_size % 3 = 0 THEN 'FUZZY' ELSE 'EXACT' END AS match_type, 'SPECIES' AS taxon_rank, CASE WHEN p_size % 5 = 0 THEN 'DOUBTFUL' ELSE 'ACCEPTED' END AS status, NULL::VARCHAR AS scientific, NULL::VARCHAR AS canonical FROM part WHERE p_partkey % 50 IN (13, 48)
  UNION ALL SELECT {GENUS}, 'GENUS', {KINGDOM}, 'EXACT', 'GENUS', 'ACCEPTED', {GENUS} || ' (Économy & Weldon, 1758)', {GENUS} FROM part)"""


@query(
    "c06_evidence_override",
    f"""WITH {BASE}, {ANSWERS}, nk AS (SELECT DISTINCT genus, epithet, kingdom FROM names),
sa AS (SELECT name, kingdom, bool_or(match_type = 'EXACT' AND taxon_rank IN {sql_list(C.SPECIES_RANKS)} AND status IN ('ACCEPTED', 'SYNONYM')) AS is_species FROM answers WHERE rank IS NULL GROUP BY ALL),
ga AS (SELECT DISTINCT name, kingdom, {sql_fold('t')} AS t FROM (SELECT name, kingdom, unnest(regexp_split_to_array(regexp_replace(lower(substr(scientific, length(canonical) + 1)), '[()\\[\\],;&:\\d]', ' ', 'g'), '\\s+')) AS t FROM answers WHERE rank = 'GENUS') WHERE t <> ''),
j AS (SELECT cls.*, nk.kingdom, coalesce(sa.is_species, false) AS is_species, ga.t IS NOT NULL AS wrote, coalesce(a.n, 0) AS ac, coalesce(e.n, 0) AS ec, b.name IS NOT NULL AS known FROM cls JOIN nk ON nk.genus = cls.genus AND nk.epithet = cls.epithet
  LEFT JOIN sa ON sa.name = cls.genus || ' ' || cls.epithet AND sa.kingdom = nk.kingdom LEFT JOIN ga ON ga.name = cls.genus AND ga.kingdom = nk.kingdom AND ga.t = {sql_fold('cls.epithet')} LEFT JOIN authors a ON a.token = {sql_fold('cls.epithet')}
  LEFT JOIN epithets e ON e.token = {sql_fold('cls.epithet')} LEFT JOIN binomials b ON b.name = {sql_fold('cls.genus')} || ' ' || ltrim({sql_fold('cls.epithet')}, '×')),
o AS (SELECT *, category = 'A' AND subtype = 'author_only_single' AND reason IN ('genus_authority', 'author_name') AND is_species AS clean, category = 'C' AND subtype = 'single_word' AND NOT known AND ac >= 5 AND ac >= 20 * ec AND NOT is_species AND wrote AS author FROM j)
SELECT genus, epithet, kingdom, CASE WHEN clean THEN 'C' WHEN author THEN 'A' ELSE category END AS category, CASE WHEN clean THEN 'single_word' WHEN author THEN 'author_only_single' ELSE subtype END AS subtype,
  CASE WHEN clean THEN 'gbif_exact_species' WHEN author THEN 'gbif_genus_authority' ELSE reason END AS reason FROM o""",
)
def c06(spark, d):
    p = table(spark, d, "part")
    none = F.lit(None).cast("string")
    species = p.where("p_partkey % 50 IN (13, 48)").select(F.expr(ANSWER).alias("name"), none.alias("rank"), F.expr(KINGDOM).alias("kingdom"), F.when(c("p_size") % 3 == 0, "FUZZY").otherwise("EXACT").alias("match_type"), F.lit("SPECIES").alias("taxon_rank"), F.when(c("p_size") % 5 == 0, "DOUBTFUL").otherwise("ACCEPTED").alias("status"), none.alias("scientific"), none.alias("canonical"))
    genera = p.select(F.expr(GENUS), F.lit("GENUS"), F.expr(KINGDOM), F.lit("EXACT"), F.lit("GENUS"), F.lit("ACCEPTED"), F.concat(F.expr(GENUS), F.lit(" (Économy & Weldon, 1758)")), F.expr(GENUS))
    kingdoms = names(spark, d).select("genus", "epithet", "kingdom").distinct()
    rows, ev = names(spark, d), evidence(spark, d)
    found = C.classified(rows, "genus", "epithet", ev, C.suffix_evidence(rows, "epithet"))
    return C.overridden(found.join(kingdoms, ["genus", "epithet"]), ev, species.union(genera))


KEYED = "keyed AS (SELECT n.genus || '|' || n.epithet AS key, n.split, cls.category, cls.subtype FROM names n JOIN cls ON cls.genus = n.genus AND cls.epithet = n.epithet), per AS (SELECT key, category, subtype, count(*) FILTER (WHERE split = 'train') AS tr, count(*) FILTER (WHERE split = 'val') AS va FROM keyed GROUP BY ALL)"


def keyed(spark, d):
    return names(spark, d).join(classes(spark, d), ["genus", "epithet"]).withColumn("key", F.concat_ws("|", "genus", "epithet"))


@query("p11_census_report", f"WITH {BASE}, {KEYED} SELECT category, subtype, count(*) AS n_keys, count(*) FILTER (WHERE tr > 0) AS n_train_keys, count(*) FILTER (WHERE va > 0) AS n_val_keys, CAST(sum(tr) AS BIGINT) AS train_images, CAST(sum(va) AS BIGINT) AS val_images FROM per GROUP BY ALL")
def p11(spark, d):
    return C.report(keyed(spark, d), "key", "split")


@query("p11_top_keys", f"WITH {BASE}, {KEYED}, r AS (SELECT subtype, row_number() OVER (PARTITION BY subtype ORDER BY tr DESC, key) AS place, key, tr AS n_tr FROM per) SELECT * FROM r WHERE place <= 10")
def p11_top(spark, d):
    return C.top_keys(keyed(spark, d), "key", "split")


def sizes_sql(where: str) -> str:
    return f"SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(max(ceil(n / 16)) AS BIGINT) AS max_groups, CAST(sum(ceil(n / 16)) AS BIGINT) AS total_groups FROM (SELECT key, count(*) AS n FROM keyed WHERE split = 'train' AND {where} GROUP BY 1)"


@query("p11_drop_effects", f"WITH {BASE}, {KEYED} " + " UNION ALL ".join(f"SELECT '{name}' AS dropped, * FROM ({sizes_sql(where)})" for name, where in (("nothing", "true"), ("P", "category <> 'P'"), ("P and A", "category NOT IN ('P', 'A')"), ("P and lone A", "category <> 'P' AND (category <> 'A' OR subtype = 'epithet_plus_author')"))))
def p11_effects(spark, d):
    """Rows, keys and groups of 16 that are left to train on when categories go: one pass over the keys."""
    cat, sub = c("category"), c("subtype")
    cases = {"nothing": F.lit(True), "P": cat != "P", "P and A": ~cat.isin("P", "A"), "P and lone A": (cat != "P") & ((cat != "A") | (sub == "epithet_plus_author"))}
    per = keyed(spark, d).where("split = 'train'").groupBy("key", "category", "subtype").agg(F.count("*").alias("n"))
    left = per.select("n", F.explode(F.filter(F.array(*[F.when(x, F.lit(name)) for name, x in cases.items()]), lambda x: x.isNotNull())).alias("dropped"))
    groups = F.ceil(c("n") / 16).cast("long")
    return left.groupBy("dropped").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.max(groups).alias("max_groups"), F.sum(groups).alias("total_groups"))
