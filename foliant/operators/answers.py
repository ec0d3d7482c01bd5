"""Deterministic steps around model answers: the JSON envelope, citations, routing, the claim gate, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


# Authority levels by precedence, their names in prompts, and the labels of the router.
AUTHORITY_RANK = {"internal_hr_ruling": 0, "official_convenio": 0, "national_law": 1}
AUTHORITY_LABEL = {"national_law": "ley nacional / Estatuto (base mínima)", "official_convenio": "convenio (gobierna su materia)", "internal_hr_ruling": "resolución interna de RR. HH."}
ROUTES = ("salary", "prose", "off_domain")
MARKER = r"\[Fuente\s+(\d+)\]"

# How the prompts close.
CLOSING = (
    "Recuerda: prioriza el convenio donde regule el tema; usa la ley nacional solo para lo que el convenio no cubra. Enuncia el contenido "
    "sustantivo y deja que [Fuente N] indique la procedencia — no escribas frases sobre de qué documento procede un dato. CADA afirmación "
    "sustantiva lleva su propio [Fuente N]; si ninguna fuente la respalda, OMÍTELA (no enuncies datos que no puedas citar). Responde en el "
    "idioma de la pregunta y devuelve solo el JSON."
)
GROUND_CLOSING = (
    "Clasifica cada afirmación (sustantiva/procedencia) y evalúa el entrañamiento SOLO de las sustantivas. Recuerda la guía de precisión: "
    "una cifra/regla con envoltorio atributivo es sustantiva. Devuelve solo el JSON."
)

ANSWER_SCHEMA = "answer string, confidence string, cited_sources array<string>"
ROUTE_SCHEMA = "label string, confidence string, subqueries array<string>"
CLAIM_SCHEMA = "claims array<struct<claim:string,tipo:string,grounded:boolean,supporting_source:string>>"


def envelope(text: Column) -> Column:
    """The JSON object in a model's answer: a fenced block first, else from the first brace to the last."""
    t = F.trim(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(braces != "", braces).otherwise(t)


def parsed(text: Column, schema: str) -> tuple[Column, Column]:
    """The envelope as a struct, and whether it was a JSON object."""
    raw = envelope(text)
    return F.from_json(raw, schema), F.coalesce(F.try_parse_json(raw).isNotNull() & raw.startswith("{"), F.lit(False))


def authority_label(level: Column) -> Column:
    out = F.lit("fuente")
    for name, said in AUTHORITY_LABEL.items():
        out = F.when(level == name, said).otherwise(out)
    return out


def _rank(level: Column) -> Column:
    out = F.lit(99)
    for name, rank in AUTHORITY_RANK.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def citation_map(cited: Column, chunks: Column) -> Column:
    """ARRAY<STRUCT<position, display>> of the valid citations, in the order cited.

    `cited` holds 1-based places in `chunks` as text; those that are no integers or out of range
    go. Different places of one chunk share its display number; numbers follow the first mention."""
    places = F.filter(F.transform(cited, lambda c: c.try_cast("double").try_cast("int")), lambda p: p.isNotNull() & (p >= 1) & (p <= F.size(chunks)))
    places = F.array_distinct(F.coalesce(places, F.array().cast("array<int>")))
    ids = F.transform(places, lambda p: F.element_at(chunks, p)["chunk_id"])
    order = F.array_distinct(ids)
    return F.zip_with(places, ids, lambda p, i: F.struct(p.alias("position"), F.array_position(order, i).cast("int").alias("display")))


def renumber(answer: Column, mapping: Column) -> Column:
    """Markers [Fuente N] with display numbers; those not in the mapping go, and the spaces around them are tidied."""
    pieces = F.split(answer, MARKER)
    numbers = F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1))

    def marker(n: Column) -> Column:
        hit = F.filter(mapping, lambda m: m["position"] == n.try_cast("int"))
        return F.when(F.size(hit) > 0, F.concat(F.lit("[Fuente "), F.get(hit, F.lit(0))["display"].cast("string"), F.lit("]"))).otherwise(F.lit(""))

    joined = F.array_join(F.zip_with(pieces, numbers, lambda p, n: F.concat(p, F.when(n.isNotNull(), marker(n)).otherwise(""))), "")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"(?U)\s{2,}", " "), r"(?U)\s+([.,;:])", "$1"))


def synthesis(answers: DataFrame) -> DataFrame:
    """From raw model answers (turn_id, raw_text, chunks) the citations, the renumbered answer, the grounding signal and the authorities used."""
    e, ok = parsed(F.col("raw_text"), ANSWER_SCHEMA)
    rows = answers.withColumns({"__e": e, "parse_error": ~ok}).withColumn("__m", F.when(~F.col("parse_error"), citation_map(F.col("__e.cited_sources"), F.col("chunks"))))
    first = F.filter("__m", lambda m, i: ~F.exists(F.slice(F.col("__m"), F.lit(1), i), lambda x: x["display"] == m["display"]))
    cited = F.transform(first, lambda m: F.element_at(F.col("chunks"), m["position"]))
    rows = rows.withColumn("__c", F.coalesce(cited, F.array().cast(answers.schema["chunks"].dataType)))
    levels = F.array_distinct(F.filter(F.transform("__c", lambda c: c["authority_level"]), lambda a: a.isNotNull() & (a != "")))
    ranked = F.transform(F.array_sort(F.transform(levels, lambda a: F.struct(_rank(a).alias("r"), a.alias("a")))), lambda x: x["a"])
    answer = F.when(F.col("parse_error"), "").otherwise(renumber(F.coalesce("__e.answer", F.lit("")), F.col("__m")))
    top = F.when(F.col("parse_error") | (F.size("chunks") <= 0), 0.0).otherwise(F.round(F.coalesce(F.array_max(F.transform("chunks", lambda c: c["score"])), F.lit(0.0)), 6))
    out = rows.select("turn_id", answer.alias("answer"), F.transform("__c", lambda c: F.struct(*[c[f].alias(f) for f in ("chunk_id", "document_id", "page_from", "page_to", "authority_level")])).alias("citations"), F.size("__c").alias("citation_count"), top.alias("top_chunk_score"), F.when(F.col("parse_error"), 0.0).otherwise(F.coalesce(F.col("__e.confidence").try_cast("double"), F.lit(0.0))).alias("confidence"), ranked.alias("authority_used"), "parse_error")
    return out.withColumn("grounded", (F.col("citation_count") >= 1) & (F.col("answer") != ""))


def route(outputs: DataFrame) -> DataFrame:
    """Router outputs (turn_id, raw_text) normalised: unknown labels are prose, blank sub-queries go, what cannot be parsed is prose at confidence 0."""
    e, ok = parsed(F.col("raw_text"), ROUTE_SCHEMA)
    rows = outputs.withColumns({"__e": e, "__ok": ok})
    name = F.lower(F.trim(F.coalesce("__e.label", F.lit("prose"))))
    none = F.array().cast("array<string>")
    subs = F.filter(F.transform(F.coalesce("__e.subqueries", none), lambda s: F.trim(s)), lambda s: s != "")
    return rows.select(
        "turn_id",
        F.when(F.col("__ok") & name.isin(*ROUTES), name).otherwise("prose").alias("label"),
        F.when(F.col("__ok"), F.coalesce(F.col("__e.confidence").try_cast("double"), F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(F.col("__ok"), subs).otherwise(none).alias("subqueries"),
        F.when(F.col("__ok"), "llm").otherwise("router_parse_error").alias("reason"),
    )


def claim_gate(outputs: DataFrame) -> DataFrame:
    """Claim checks (turn_id, raw_text, stop_reason): grounded if some claim is substantive and every one that says something is grounded.

    Anything not marked as provenance is substantive. A verdict that is not a JSON boolean counts as not grounded."""
    e, ok = parsed(F.col("raw_text"), CLAIM_SCHEMA)
    rows = outputs.withColumns({"__e": e, "__ok": ok, "__cut": F.coalesce(F.col("stop_reason") == "max_tokens", F.lit(False))})
    empty = F.array().cast("array<struct<claim:string,tipo:string,grounded:boolean,supporting_source:string>>")
    heard = F.when(F.col("__ok") & ~F.col("__cut"), F.coalesce(F.filter("__e.claims", lambda c: c.isNotNull()), empty)).otherwise(empty)
    kind = lambda c: F.when(F.lower(F.trim(F.coalesce(c["tipo"], F.lit("")))).isin("procedencia", "provenance"), "provenance").otherwise("substantive")
    claims = F.transform(heard, lambda c: F.struct(F.trim(F.coalesce(c["claim"], F.lit(""))).alias("claim"), kind(c).alias("kind"), F.coalesce(c["grounded"], F.lit(False)).alias("grounded"), c["supporting_source"].alias("supporting_source")))
    rows = rows.withColumn("claims", claims)
    substantive = F.filter("claims", lambda c: c["kind"] == "substantive")
    loose = F.transform(F.filter(substantive, lambda c: ~c["grounded"] & (c["claim"] != "")), lambda c: c["claim"])
    outcome = F.when(F.col("__cut"), "grounding_truncated").when(~F.col("__ok"), "parse_error").otherwise("checked")
    noted = F.when(F.col("__cut"), F.array(F.lit("<grounding check truncated>"))).when(~F.col("__ok"), F.array(F.lit("<grounding check unparseable>"))).otherwise(loose)
    out = rows.select("turn_id", "claims", F.size(substantive).alias("substantive_count"), (F.size("claims") - F.size(substantive)).alias("provenance_count"), noted.alias("ungrounded"), outcome.alias("outcome"))
    return out.withColumn("grounded", (F.col("substantive_count") >= 1) & (F.size("ungrounded") == 0))


def user_prompt(question: Column, chunks: Column, closing: str = CLOSING) -> Column:
    """The question and its numbered sources with their authority and pages."""

    def source(c: Column, i: Column) -> Column:
        pages = F.when(c["page_from"].isNull(), "").otherwise(F.concat(F.lit(", p. "), c["page_from"].cast("string"), F.when(c["page_to"].isNotNull() & (c["page_to"] != c["page_from"]), F.concat(F.lit("–"), c["page_to"].cast("string"))).otherwise("")))
        return F.concat(F.lit("[Fuente "), (i + 1).cast("string"), F.lit("] ("), authority_label(c["authority_level"]), pages, F.lit("): "), c["content"])

    head = F.array(F.concat(F.lit("Pregunta: "), question), F.lit(""), F.lit("FUENTES disponibles:"))
    return F.array_join(F.concat(head, F.transform(chunks, source), F.array(F.lit(""), F.lit(closing))), "\n")


def ground_prompt(question: Column, answer: Column, chunks: Column, closing: str = GROUND_CLOSING) -> Column:
    """The question, the answer and its cited sources, tables marked as such."""
    source = lambda c, i: F.concat(F.lit("[Fuente "), (i + 1).cast("string"), F.lit("]"), F.when(c["is_tabular"], " [TABLA/COLUMNAS]").otherwise(""), F.lit(": "), c["content"])
    head = F.array(F.concat(F.lit("Pregunta: "), question), F.lit(""), F.concat(F.lit("Respuesta propuesta:\n"), answer), F.lit(""), F.lit("FUENTES citadas:"))
    return F.array_join(F.concat(head, F.transform(chunks, source), F.array(F.lit(""), F.lit(closing))), "\n")


