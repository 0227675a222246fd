"""Label census: evidence from a taxonomy and a catalog, and the ordered rules that classify names.

Rules run once for each distinct (genus, epithet).  A token's evidence is joined to it, so that the
vocabularies may have any size; the cascade itself is column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, words
from ..scratch import written


# The census' word lists, its author connectors, the second cascade's lists and its Latin endings.
PH_WHOLE = (
    "sp", "sp.", "spp", "spp.", "ssp", "ssp.", "subsp", "subsp.", "sp.nov", "sp.nov.", "sp. nov.", "nov", "nov.", "n.sp.", "n. sp.", "x",
    "×", "xx", "xxx", "indet", "indet.", "unknown", "unidentified", "undetermined", "undet.", "cf", "cf.", "aff", "aff.", "nr", "nr.",
    "gen.", "spec.", "species", "ss.", "s.l.", "s.s.", "complex", "group", "hybrid", "cv", "cv.", "var", "var.", "f.", "form", "morph",
    "sect.", "subg.", "ser.", "ined.", "na", "none", "null", "-",
)
P_LEAD = (
    "sp", "sp.", "spp", "spp.", "ssp.", "cf", "cf.", "aff", "aff.", "nr", "nr.", "near", "nov.", "sp.nov", "n.sp.", "indet.", "subg.",
    "subgen.", "sect.", "subsect.", "ser.", "gen.", "morph", "cv", "cv.", "ss.", "-",
)
P_INNER = (
    "sp", "sp.", "spp", "spp.", "prob.",
)
S_MARK = (
    "ssp", "ssp.", "subsp", "subsp.", "var", "var.", "f.", "fo.", "forma", "form", "ab.", "ab", "race", "nothosubsp.", "nothovar.",
    "subvar.", "lusus", "morph",
)
O_MARK = {"group": "cultivar_or_species_group", "complex": "complex_or_aggregate", "agg.": "complex_or_aggregate", "agg": "complex_or_aggregate", "cv.": "cultivar", "cv": "cultivar", "nom.": "provisional_name", "prov.": "provisional_name", "comb.": "provisional_name", "ined.": "provisional_name", "strain": "strain_or_virus", "virus": "strain_or_virus", "pv.": "strain_or_virus"}
UNKNOWN_WORDS = (
    "unknown", "unidentified", "unident.", "indet", "indet.", "indeterminate", "undetermined", "undet.",
)
CONNECT = (
    "ex", "et", "al.", "al", "in", "and", "&", "von", "van", "der", "den", "de", "du", "la", "le", "da", "di", "del", "della", "dos",
    "das", "y", "auct.", "non", "sensu", "emend.", "hort.",
)
PLACEHOLDERS = (
    "sp", "spp", "ssp", "species", "spec", "xx", "xxx", "x", "nov", "n", "indet", "undet", "ined", "unknown", "unidentified",
    "undescribed", "undefined", "cf", "aff", "nr", "near", "complex", "hybrid", "group", "agg", "prob", "cv", "morph", "cultivar",
)
RANK_WORDS = (
    "subg", "subgen", "sect", "ser", "subsect", "section", "subgenus", "series",
)
LATIN_ENDINGS = "a|ae|i|ii|um|us|is|es|ensis|ense|oides|ata|atus|ica|icus|ina|inus|osa|osus|ella|ellus|ana|anus|iae|orum|arum|ior|ius|ia|ea|eus|ens|ans|alis|ale|ilis"
SPECIES_RANKS = (
    "SPECIES", "SUBSPECIES", "VARIETY", "FORM", "INFRASPECIFIC_NAME",
)

#: Tokens whose dot is no abbreviation of an author.
DOTTED = tuple(dict.fromkeys([*S_MARK, *O_MARK, *PH_WHOLE, *P_LEAD, *P_INNER]))


@dataclass
class Evidence:
    """What a taxonomy knows, as two tables: tokens with their counts as author and as epithet words, and
    pairs of a genus and a token (as one text) that stand in the genus' authorship, or are a name of two
    words.  All tokens are folded; names of three words are a table of their own."""

    tokens: DataFrame
    pairs: DataFrame
    trinomials: DataFrame

    @property
    def authors(self) -> DataFrame:
        return self.tokens.where("ac > 0").select("token", F.col("ac").alias("n"))

    @property
    def epithets(self) -> DataFrame:
        return self.tokens.where("ec > 0").select("token", F.col("ec").alias("n"))

    @property
    def genus_authors(self) -> DataFrame:
        return self.pairs.where("ga").select(F.regexp_replace("pair", " [^ ]*$", "").alias("genus"), F.substring_index("pair", " ", -1).alias("token"))

    @property
    def binomials(self) -> DataFrame:
        return self.pairs.where("known").select(F.col("pair").alias("name"))


def _nonempty(xs: Column) -> Column:
    return F.filter(xs, lambda w: w != "")


def author_tokens(authority: Column) -> Column:
    """The distinct tokens of an author string: lower-cased, years and separators away; a token with an
    inner dot also gives its dotted parts, one with an apostrophe its parts of two characters or more."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.lower(authority), "’‘", "''"), r"\p{Nd}+", " "), r"[()\[\],;&:\"]", " ")
    base = _nonempty(F.split(plain, " "))
    dotted = F.flatten(F.transform(F.filter(base, lambda t: t.rlike(r"\.[^.]")), lambda t: F.transform(_nonempty(F.split(t, r"\.")), lambda x: F.concat(x, F.lit(".")))))
    quoted = F.flatten(F.transform(F.filter(base, lambda t: F.contains(t, F.lit("'"))), lambda t: F.filter(F.split(t, "'"), lambda x: F.char_length(x) > 1)))
    return F.array_distinct(F.concat(base, dotted, quoted))


def evidence(taxa: DataFrame, rank: str, name: str, authority: str) -> Evidence:
    """Evidence of a taxonomy's rows, written once.  Rows without a name or an authority give none of that
    kind.  Rows of one authority have the same tokens, which are therefore made and folded once."""
    named = taxa.where(F.col(authority).isNotNull()).groupBy(F.col(authority).alias("a")).agg(F.count("*").alias("rows"))
    tokens = named.select("a", "rows", F.explode(author_tokens(F.col("a"))).alias("t")).select("a", "rows", fold("t").alias("token")).distinct()
    zero, one = F.lit(0).cast("long"), F.lit(True)
    w = taxa.where(F.col(name).isNotNull()).select(F.split(F.lower(name), " ").alias("w")).where(F.size("w") >= 2)
    epithets = w.select(F.explode(_nonempty(F.slice("w", F.lit(2), F.size("w")))).alias("e")).groupBy("e").agg(F.count("*").alias("k"))
    counts = tokens.select("token", F.col("rows").alias("ac"), zero.alias("ec")).unionByName(epithets.select(fold("e").alias("token"), zero.alias("ac"), F.col("k").alias("ec")))
    genera = taxa.where((F.col(rank) == "genus") & F.col(name).isNotNull() & F.col(authority).isNotNull()).select(F.col(name).alias("g"), F.col(authority).alias("a")).distinct()
    first = lambda k: w.where(F.size("w") >= k).select(F.array_join(F.slice("w", 1, k), " ").alias("b")).distinct().select(fold("b").alias("b"))
    authorship = genera.join(tokens.select("a", "token"), "a").select(F.concat_ws(" ", fold("g"), "token").alias("pair"), one.alias("ga"), F.lit(False).alias("known"))
    pairs = authorship.unionByName(first(2).select(F.col("b").alias("pair"), F.lit(False).alias("ga"), one.alias("known"))).groupBy("pair").agg(F.bool_or("ga").alias("ga"), F.bool_or("known").alias("known"))
    return Evidence(written(counts.groupBy("token").agg(F.sum("ac").alias("ac"), F.sum("ec").alias("ec")), "census-tokens"), written(pairs, "census-pairs"), first(3).select(F.col("b").alias("name")).distinct())


def suffix_evidence(names: DataFrame, epithet: str) -> DataFrame:
    """(suffix, n_epithets, n_first): for the last words of distinct epithets of several words, how many
    end so, and with how many different first words."""
    w = names.select(epithet).distinct().where(F.contains(epithet, F.lit(" "))).select(F.split(epithet, " ").alias("w"))
    return w.select(F.element_at("w", -1).alias("suffix"), F.get("w", F.lit(0)).alias("first")).groupBy("suffix").agg(F.count("*").alias("n_epithets"), F.count_distinct("first").alias("n_first"))


def _tokens(epithet: Column) -> tuple[Column, Column]:
    """The words of an epithet, a leading hybrid sign joined to its word; and whether there was one."""
    raw = F.split(epithet, " ")
    head = F.get(raw, F.lit(0))
    apart = head.isin("x", "×") & (F.size(raw) >= 2)
    joined = F.concat(F.array(F.concat(F.lit("×"), F.get(raw, F.lit(1)))), F.slice(raw, F.lit(3), F.size(raw)))
    return F.when(apart, joined).otherwise(raw), apart | head.startswith("×")


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, "^×+", "")


def author_reasons(names: DataFrame, genus: str, epithet: str, ev: Evidence, suffixes: DataFrame) -> DataFrame:
    """(genus, epithet, pos, reason): for each distinct name its first word that is author or year
    material, and why; names without one have no row."""
    words_, _ = _tokens(F.col("epithet"))
    rows = names.select(F.col(genus).alias("genus"), F.col(epithet).alias("epithet")).distinct().where("genus IS NOT NULL AND epithet IS NOT NULL")
    rows = rows.select("genus", "epithet", F.size(words_).alias("size"), F.posexplode(words_).alias("pos", "w"))
    rows = rows.withColumn("t", F.when(F.col("pos") == 0, _bare(F.col("w"))).otherwise(F.col("w"))).where("pos > 0 OR t <> ''")
    rows = rows.withColumns({"ft": fold("t"), "g": fold("genus")}).withColumn("pair", F.concat_ws(" ", "g", "ft"))
    j = rows.join(ev.tokens.withColumnRenamed("token", "ft"), "ft", "left").join(ev.pairs, "pair", "left")
    j = j.join(suffixes.select(F.col("suffix").alias("t"), "n_first"), "t", "left")
    t, later = F.col("t"), F.col("pos") >= 1
    ac, ec, fresh = F.coalesce("ac", F.lit(0)), F.coalesce("ec", F.lit(0)), later | ~F.coalesce("known", F.lit(False))
    ends = later & (F.col("pos") == F.col("size") - 1)
    suffix = ((F.col("n_first") >= 3) & (ac >= 1) & (ac >= ec)) | ((F.col("n_first") >= 5) & (ec <= 2))
    reason = (
        F.when(t.rlike(r"\p{Nd}"), "digit")
        .when(t.rlike(r"[()\[\]&,;]"), "punctuation")
        .when(later & t.isin(*CONNECT), "author_connector")
        .when(t.endswith("-") & (F.char_length(t) > 1), "truncated_author")
        .when(F.contains("ft", F.lit("'")) & ~(t.startswith("'") | t.endswith("'")), "apostrophe_name")
        .when(F.contains(t, F.lit(".")) & ~t.isin(*DOTTED), "abbreviation")
        .when(F.col("ga") & fresh, "genus_authority")
        .when((ac >= 2) & (ec == 0) & fresh, "author_name")
        .when(later & (ac >= 5) & (ac >= 20 * ec), "author_name_mostly")
        .when(ends & suffix, "author_name_catalog_suffix")
    )
    hits = j.withColumn("reason", reason).where("reason IS NOT NULL")
    return hits.groupBy("genus", "epithet").agg(F.min(F.struct("pos", "reason")).alias("f")).select("genus", "epithet", "f.pos", "f.reason")


def classified(names: DataFrame, genus: str, epithet: str, ev: Evidence, suffixes: DataFrame) -> DataFrame:
    """(genus, epithet, category, subtype, reason, hybrid, epithet_part), one row for each distinct name.

    P placeholder, A author or year material, S subspecific or several words, O other, C clean.  The
    first rule that holds decides; a null epithet or genus has no row.
    """
    rows = names.select(F.col(genus).alias("genus"), F.col(epithet).alias("epithet")).distinct().where("genus IS NOT NULL AND epithet IS NOT NULL")
    rows = rows.join(author_reasons(rows, "genus", "epithet", ev, suffixes), ["genus", "epithet"], "left")
    s = F.col("epithet")
    words_, sign = _tokens(s)
    # Columns of their own: each is made once, and stands in many rules.
    rows = rows.withColumns({"raw": F.split(s, " "), "toks": words_, "sign": sign})
    raw, toks, hybrid = F.col("raw"), F.col("toks"), F.col("sign")
    rest = lambda w: F.slice(w, F.lit(2), F.size(w))
    inner = F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 2, F.lit(0)))
    among = lambda w, names_: F.exists(w, lambda t: t.isin(*names_))
    one = F.size(toks) == 1
    marked = lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in O_MARK.items() for x in kv]), t), F.when(t.startswith("'") | t.endswith("'"), F.lit("cultivar")))
    mark = F.get(F.filter(F.transform(rest(toks), marked), lambda x: x.isNotNull()), F.lit(0))
    plain = F.forall(toks, lambda t: _bare(t).rlike(r"^[\p{L}\p{Nl}\p{No}]+(-[\p{L}\p{Nl}\p{No}]+)*$"))
    formula = F.array_contains(raw, "=") | F.contains(s, F.lit("_x_")) | among(inner, ("x", "×")) | ((F.size(raw) >= 3) & F.element_at(raw, -1).isin("x", "×"))
    rules = (
        (s.isin(*PH_WHOLE), "P", "bare_token"),
        (s.rlike(r"^\p{Nd}+$"), "P", "bare_number"),
        (F.contains(s, F.lit("?")), "P", "question_mark"),
        (s.startswith("undescribed") | s.startswith("undefined") | s.isin(*UNKNOWN_WORDS), "P", "undescribed_or_undefined"),
        (F.get(raw, F.lit(0)).isin(*P_LEAD) | s.startswith("'") | s.startswith("- "), "P", "qualified_or_rank_marker"),
        (F.contains(s, F.lit("_or_")) | F.contains(s, F.lit(" or ")), "P", "either_or"),
        (among(rest(raw), P_INNER), "P", "inner_sp_or_prob"),
        (s.rlike("(taxonomy|geo):"), "O", "machine_tag"),
        (s.rlike(r"^\p{Nd}+-[a-z]+$"), "O", "numeral_epithet"),
        (s.rlike("virus|viroid|phytoplasma") | among(raw, ("strain", "pv.", "bv.")), "O", "strain_or_virus"),
        (formula, "O", "hybrid_formula"),
        ((F.col("pos") == 0) & one, "A", "author_only_single"),
        (F.col("pos") == 0, "A", "author_only_multi"),
        (F.col("pos") > 0, "A", "epithet_plus_author"),
        (one & F.contains(s, F.lit("_")), "O", "underscore_label"),
        (one & F.contains(s, F.lit("'")), "O", "stray_quote"),
        (one & hybrid, "C", "hybrid_nothospecies"),
        (one, "C", "single_word"),
        (mark.isNotNull(), "O", mark),
        (among(rest(toks), S_MARK), "S", "with_rank_marker"),
        (plain & (F.size(toks) == 2), "S", "two_words"),
        (plain, "O", "three_plus_plain_words"),
    )
    found = F.struct(F.lit("O").alias("category"), F.lit("other").alias("subtype"))
    for when, cat, sub in reversed(rules):
        found = F.when(when, F.struct(F.lit(cat).alias("category"), (F.lit(sub) if isinstance(sub, str) else sub).alias("subtype"))).otherwise(found)
    out = rows.withColumn("k", found).select("genus", "epithet", "pos", "reason", "raw", "toks", "sign", "k")
    author = F.col("k.category") == "A"
    part = F.when(F.col("k.subtype") == "epithet_plus_author", F.array_join(F.slice(toks, F.lit(1), F.col("pos")), " "))
    early = F.col("k.subtype").isin("bare_token", "bare_number", "question_mark", "undescribed_or_undefined", "qualified_or_rank_marker", "either_or", "inner_sp_or_prob", "machine_tag", "numeral_epithet", "hybrid_formula") | s.rlike("virus|viroid|phytoplasma") | among(raw, ("strain", "pv.", "bv."))
    return out.select("genus", "epithet", "k.category", "k.subtype", F.when(author, F.col("reason")).alias("reason"), (hybrid & ~early).alias("hybrid"), part.alias("epithet_part"))


def overridden(names: DataFrame, ev: Evidence, answers: DataFrame) -> DataFrame:
    """classified names (with kingdom) after the cached answers of a name service: a lone author word
    that it knows as a species is clean; a clean word that mostly names authors, is no known species and
    stands in its genus' authorship is an author.

    answers: (name, rank, kingdom, match_type, taxon_rank, status, scientific, canonical); rank is null
    for species.  Names without an answer stay as they are.
    """
    real = (F.col("match_type") == "EXACT") & F.col("taxon_rank").isin(*SPECIES_RANKS) & F.col("status").isin("ACCEPTED", "SYNONYM")
    species = answers.where("rank IS NULL").select(F.col("name").alias("_name"), F.col("kingdom").alias("_kingdom"), F.coalesce(real, F.lit(False)).alias("is_species")).groupBy("_name", "_kingdom").agg(F.max("is_species").alias("is_species"))
    wrote = F.regexp_replace(F.lower(F.substring("scientific", F.length("canonical") + 1, F.length("scientific"))), r"[()\[\],;&:\p{Nd}]", " ")
    genera = answers.where("rank = 'GENUS' AND scientific IS NOT NULL AND canonical IS NOT NULL").select(F.col("name").alias("_genus"), F.col("kingdom").alias("_kingdom"), F.explode(_nonempty(F.split(wrote, r"\s+"))).alias("_t"))
    genera = genera.select("_genus", "_kingdom", fold("_t").alias("_ft")).distinct().withColumn("in_authorship", F.lit(True))
    rows = names.withColumns({"_fe": fold("epithet"), "_fg": fold("genus")}).withColumns({"_name": F.concat_ws(" ", "genus", "epithet"), "_b": F.concat_ws(" ", "_fg", F.regexp_replace("_fe", "^×+", ""))})
    j = rows.join(species, (rows["_name"] == species["_name"]) & (rows["kingdom"] == species["_kingdom"]), "left").drop(species["_name"], species["_kingdom"])
    j = j.join(genera, (j["genus"] == genera["_genus"]) & (j["kingdom"] == genera["_kingdom"]) & (j["_fe"] == genera["_ft"]), "left")
    j = j.join(ev.tokens.withColumnRenamed("token", "_a"), F.col("_fe") == F.col("_a"), "left")
    j = j.join(ev.pairs.where("known").select(F.col("pair").alias("_n"), "known"), F.col("_b") == F.col("_n"), "left")
    ac, ec, is_species = F.coalesce("ac", F.lit(0)), F.coalesce("ec", F.lit(0)), F.coalesce("is_species", F.lit(False))
    clean = (F.col("category") == "A") & (F.col("subtype") == "author_only_single") & F.col("reason").isin("genus_authority", "author_name") & is_species
    weak = (F.col("category") == "C") & (F.col("subtype") == "single_word") & F.col("known").isNull() & (ac >= 5) & (ac >= 20 * ec)
    author = weak & ~is_species & F.coalesce("in_authorship", F.lit(False))
    new = lambda col, to, then: F.when(clean, to).when(author, then).otherwise(F.col(col)).alias(col)
    return j.select("genus", "epithet", "kingdom", new("category", "C", "A"), new("subtype", "single_word", "author_only_single"), new("reason", "gbif_exact_species", "gbif_genus_authority"))


def epithet_like(t: Column, ac: Column, ec: Column) -> Column:
    """Whether a word looks like a Latin epithet: a plain word of three letters or more, no placeholder,
    not mainly an author's name (ac uses as an author, ec as an epithet)."""
    w = F.regexp_replace(t, r"^\p{Nd}+-", "")
    return ~w.isin(*PLACEHOLDERS) & (F.char_length(w) >= 3) & w.rlike(r"^[a-zà-ÿ][a-zà-ÿ-]*$") & ~((ac >= 1) & ((ec == 0) | (ac >= 5 * (ec + 1))))


def drop_reasons(names: DataFrame, tokens: DataFrame, species: DataFrame) -> DataFrame:
    """names with `reason_to_drop`: why no real epithet stands in a name that the census did not find
    clean, or null where one does.

    names: (genus, epithet, category, subtype, ...); tokens: (token, ac, ec), counts as author and as
    epithet words; species: (genus, word), lower-cased, the known species of each genus.
    """
    s, sub, cat = F.trim("epithet"), F.col("subtype"), F.col("category")
    base = names.select("genus", "epithet", "category", "subtype").distinct()
    tag_free = F.regexp_replace(s, r"taxonomy:\S+|geo:\S+", " ")
    source = F.when(sub == "machine_tag", tag_free).otherwise(s)
    stem = F.regexp_replace(s, r"\.+$", "")
    all_words = F.concat(F.transform(words(source), lambda t, i: F.struct(i.alias("at"), t.alias("t"))), F.array(F.struct(F.lit(-1).alias("at"), stem.alias("t"))))
    rows = base.select("genus", "epithet", "category", "subtype", F.explode(all_words).alias("x")).select("genus", "epithet", "category", "subtype", "x.at", "x.t").withColumn("bare", F.regexp_replace("t", r"^\p{Nd}+-", ""))
    # Counts of the bare word decide whether it is like an epithet, counts of the word as it stands whether it is known.
    j = rows.join(tokens.toDF("bare", "ac", "bec"), "bare", "left").join(tokens.toDF("t", "tac", "ec"), "t", "left")
    j = j.join(species.select(F.col("genus").alias("_g"), F.col("word").alias("t"), F.lit(True).alias("known")).distinct().withColumnRenamed("t", "_t"), (F.lower("genus") == F.col("_g")) & (F.col("t") == F.col("_t")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    like, used, latin = epithet_like(F.col("t"), zero("ac"), zero("bec")), zero("ec") >= 1, F.col("t").rlike(f"^.{{2,}}({LATIN_ENDINGS})$")
    word, at = F.col("at") >= 0, F.col("at")
    stray = (at == -1) & like & (used | ((zero("tac") == 0) & (F.char_length("t") >= 5) & latin))
    any_ = lambda x: F.coalesce(F.max(x), F.lit(False))
    f = j.groupBy("genus", "epithet", "category", "subtype").agg(
        any_(stray).alias("stray"), any_(word & like).alias("some_like"), F.coalesce(F.min(F.when(word, like)), F.lit(False)).alias("all_like"),
        any_((at == 0) & like & used).alias("first_used"), any_((at >= 1) & like & used & latin).alias("later_latin"), any_(word & F.col("known")).alias("known"),
    )
    multi = F.contains(s, F.lit(" "))
    head = F.lower(F.regexp_replace(F.regexp_extract(s, r"^(\S+)", 1), r"^\.+|\.+$", ""))
    keeps_single = ((sub == "either_or") & F.col("some_like")) | (F.contains(s, F.lit("?")) & F.col("all_like")) | (s.startswith("'") & F.col("first_used"))
    quoted = s.startswith("- ") | (s.startswith("'") & ~F.split_part(s, F.lit("'"), F.lit(1)).rlike(r"[a-z]{3,}\s*$"))
    reason = (
        F.when(cat == "C", None)
        .when((sub == "author_only_single") & s.endswith(".") & F.col("stray"), None)
        .when(sub == "author_only_single", "single-word author name")
        .when((sub == "machine_tag") & F.col("some_like"), None)
        .when(sub == "machine_tag", "machine tag only")
        .when(~multi & (cat == "P") & ~keeps_single, "single-word placeholder")
        .when(~multi, None)
        .when(head.isin(*RANK_WORDS), "subgenus, section or series label")
        .when((sub == "author_only_multi") & ~F.col("known"), "author-only string")
        .when((sub == "author_only_multi") | (cat != "P") | head.isin("cf", "aff", "nr", "near"), None)
        .when(head.isin("sp", "spp") & ~F.col("later_latin"), "sp. plus a tag or locality")
        .when(head.isin("sp", "spp"), None)
        .when(head.isin("morph", "cv") | quoted, "morph label, cultivar marker or cultivar name")
    )
    return f.select("genus", "epithet", "category", "subtype", reason.alias("reason_to_drop"))


def report(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(category, subtype, n_keys, n_train_keys, n_val_keys, train_images, val_images): the census by
    subtype; rows are the catalog's with their category and subtype."""
    keys = rows.groupBy(key, "category", "subtype").agg(F.count_if(F.col(split) == "train").alias("tr"), F.count_if(F.col(split) == "val").alias("va"))
    return keys.groupBy("category", "subtype").agg(F.count("*").alias("n_keys"), F.count_if(F.col("tr") > 0).alias("n_train_keys"), F.count_if(F.col("va") > 0).alias("n_val_keys"), F.sum("tr").alias("train_images"), F.sum("va").alias("val_images"))


def top_keys(rows: DataFrame, key: str, split: str, k: int = 10) -> DataFrame:
    """(subtype, place, key, n_tr): the k keys of each subtype with most training rows, ties by key."""
    from pyspark.sql import Window

    keys = rows.groupBy(key, "subtype").agg(F.count_if(F.col(split) == "train").alias("n_tr"))
    place = F.row_number().over(Window.partitionBy("subtype").orderBy(F.desc("n_tr"), key))
    return keys.withColumn("place", place).where(F.col("place") <= k).select("subtype", "place", key, "n_tr")
