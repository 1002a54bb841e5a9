"""Dependency frames: extraction from parsed tokens, roles, agents, triples, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.dims import AGENT_PHRASES, AGENT_TAXONOMY, ROLE_PRIORITY
from lexmill.functions.text import ratio


def ranked(counts: DataFrame, by: list[str], value: str, most: int, n: str = "n") -> DataFrame:
    """The `most` values of the largest n in each group, ties by value; with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col(n).desc(), F.col(value).asc())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def listed(rows: DataFrame, by: list[str], value: str, name: str, most: int | None = None) -> DataFrame:
    """By group, the `most` values of a column (all, if None) as value:count joined by |, the most frequent first, ties by value."""
    counts = rows.where(F.length(value) > 0).groupBy(*by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), "value")
    counts = counts.withColumn("rank", F.row_number().over(order))
    if most is not None:
        counts = counts.where(F.col("rank") <= most)
    each = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "value", F.col("n").cast("string")).alias("shown"))))
    return counts.groupBy(*by).agg(F.array_join(F.transform(each, lambda x: x["shown"]), "|").alias(name))


def role_of(dep: Column, head_voice: Column | None = None) -> Column:
    """Syntactic role of a dependency label."""
    passive = F.lit(False) if head_voice is None else F.coalesce(head_voice == "Pass", F.lit(False))
    return (
        F.when(dep == "nsubjpass", "patient")
        .when(dep.isin("nsubj", "csubj"), F.when(passive, "patient").otherwise("agent"))
        .when(dep.isin("dobj", "obj", "iobj", "pobj"), "patient")
        .when(dep.isin("pcomp", "prep", "obl"), "oblique")
        .when(dep.isin("amod", "nmod", "compound", "appos"), "modifier")
        .otherwise("other")
    )


#: From a token to the nearest ancestor that is a verb, in as many steps as the sentence (the map _t of its tokens) has tokens; null at the root.
CLIMB = (
    "aggregate(sequence(1, size(_t)), struct({start} as at, false as done), (a, s) -> if(a.done or _t[a.at].head_i = a.at, struct(a.at as at, a.done as done), "
    "struct(_t[a.at].head_i as at, _t[_t[a.at].head_i].pos = 'VERB' as done)), a -> if(a.done, a.at, null))"
)


def governing_verbs(tokens: DataFrame) -> DataFrame:
    """(chunk_id, sent_id, i, verb_i, verb_lemma, verb_text): the nearest ancestor that is a verb; absent at the root.

    A sentence's head links travel in one map per sentence, so the climb is one
    expression a token, not a join a step; it can take as many steps as the sentence has tokens.
    """
    key = ["chunk_id", "sent_id"]
    links = tokens.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("i"), F.struct("head_i", "pos", "lemma", "text")))).alias("_t")
    )
    rows = tokens.select(*key, "i", "head_i").join(links, key)
    rows = rows.withColumn("verb_i", F.expr(CLIMB.format(start="i"))).where("verb_i is not null")
    return rows.select(*key, "i", "verb_i", F.expr("_t[verb_i].lemma").alias("verb_lemma"), F.expr("_t[verb_i].text").alias("verb_text"))


def parsed_frames(tokens: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """A frame for each token whose text or lemma is a target term, from a parser's tokens.

    Sentences and subtrees are their tokens joined by spaces; subtrees are the ranges given by `left` and `right`.
    """
    key = ["chunk_id", "sent_id"]
    wanted = [t.lower() for t in terms]
    # a sentence's tokens meet once, in one array; all else is worked out inside the row
    token = F.struct("i", "text", "lemma", "pos", "dep", "head_i", "left", "right", "voice")
    rows = tokens.groupBy(*key).agg(F.array_sort(F.collect_list(token)).alias("_s"))
    rows = rows.withColumn("_hits", F.filter("_s", lambda t: F.lower(t["text"]).isin(*wanted) | F.lower(t["lemma"]).isin(*wanted))).where(F.size("_hits") > 0)
    node = lambda t: F.struct(t["i"], F.struct(t["head_i"].alias("head_i"), t["pos"].alias("pos"), t["text"].alias("text"), t["lemma"].alias("lemma"), t["voice"].alias("voice")))
    rows = rows.withColumn("_t", F.map_from_entries(F.transform("_s", node)))
    rows = rows.select(*key, "_s", "_t", F.explode("_hits").alias("_h"))
    rows = rows.withColumns({"_head": F.expr("_t[_h.head_i]"), "verb_i": F.expr(CLIMB.format(start="_h.i"))})
    rows = rows.withColumn("_c", F.filter("_s", lambda c: (c["head_i"] == F.col("_h.i")) & (c["i"] != c["head_i"])))
    spoken = lambda found: F.array_join(F.transform(found, lambda t: t["text"]), " ")
    modifies = lambda c: c["pos"].isin("ADJ", "ADV") | c["dep"].isin("amod", "advmod", "compound")
    return rows.select(
        *key,
        F.col("_h.i").alias("token_idx"),
        F.col("_h.text").alias("target_term"),
        F.lower("_h.lemma").alias("target_lemma"),
        F.col("_head.text").alias("dep_head"),
        F.col("_head.lemma").alias("dep_head_lemma"),
        F.col("_head.pos").alias("dep_head_pos"),
        F.col("_h.dep").alias("dep_relation"),
        F.transform("_c", lambda c: F.struct(c["text"].alias("text"), c["dep"].alias("dep"), c["pos"].alias("pos"))).alias("dep_children"),
        role_of(F.col("_h.dep"), F.col("_head.voice")).alias("syntactic_role"),
        F.transform(
            F.filter("_c", modifies), lambda c: F.struct(c["text"].alias("text"), c["lemma"].alias("lemma"), c["pos"].alias("pos"), c["dep"].alias("dep"))
        ).alias("modifiers"),
        F.expr("_t[verb_i].lemma").alias("governing_verb"),
        "verb_i",
        F.expr("_t[verb_i].text").alias("verb_text"),
        spoken(F.col("_s")).alias("sentence"),
        spoken(F.filter("_s", lambda t: (t["i"] >= F.col("_h.left")) & (t["i"] <= F.col("_h.right")))).alias("subtree_text"),
    )


def agent_category(text: Column, lemma: Column) -> Column:
    """Category of an agent: a known phrase, else the last word of the lemma in a category, else a word inside the text."""
    low = F.lower(text)
    phrase = F.lit(False)
    for p in AGENT_PHRASES:
        phrase = phrase | low.contains(p)
    known = F.create_map(*[F.lit(x) for c, ws in AGENT_TAXONOMY.items() for w in ws for x in (w, c)])
    parts = F.reverse(F.split(F.lower(lemma), "\\s+"))
    named = F.filter(F.transform(parts, lambda w: F.try_element_at(known, w)), lambda c: c.isNotNull())
    inside = F.lit("OTHER")
    for c, ws in reversed(AGENT_TAXONOMY.items()):
        held = F.lit(False)
        for w in ws:
            held = held | low.contains(w)
        inside = F.when(held, c).otherwise(inside)
    return F.when(phrase, "INSTITUTIONAL").otherwise(F.coalesce(F.get(named, F.lit(0)), inside))


def verb_agents(tokens: DataFrame, verbal: bool = True) -> DataFrame:
    """(chunk_id, sent_id, i, agent_text, agent_lemma, voice, by_phrase) of every verb with an agent or a passive.

    Passive: the object of the by-phrase, else the by-phrase, else no agent. Active:
    the first subject; a relative pronoun stands for the noun that the nearest relative
    clause around it modifies. Subtrees are the token ranges given by `left` and `right`.
    Without `verbal` tokens of every part of speech are taken for verbs.
    """
    key = ["chunk_id", "sent_id"]
    verbs = tokens.where("pos in ('VERB', 'AUX')" if verbal else "true").select(*key, "i", "tag")
    kids = tokens.where("i != head_i").select(
        *key, F.col("head_i").alias("i"), F.col("i").alias("c"), F.col("dep").alias("cdep"), F.lower("lemma").alias("clemma"), "left", "right"
    )
    seen = verbs.join(kids, [*key, "i"], "left").groupBy(*key, "i", "tag").agg(
        F.max((F.col("cdep") == "auxpass").cast("int")).alias("auxpass"),
        F.max((F.col("cdep").isin("auxpass", "aux") & (F.col("clemma") == "be")).cast("int")).alias("be"),
        F.min(F.when(F.col("cdep") == "agent", F.struct("c", "left", "right", "clemma"))).alias("by"),
        F.min(F.when(F.col("cdep").isin("nsubj", "csubj"), F.struct("c", "left", "right", "clemma"))).alias("subject"),
    )
    passive = (F.coalesce("auxpass", F.lit(0)) == 1) | ((F.col("tag") == "VBN") & (F.coalesce("be", F.lit(0)) == 1))
    seen = seen.withColumn("passive", passive)
    objects = tokens.where("dep = 'pobj'").groupBy(*key, F.col("head_i").alias("by_i")).agg(F.min(F.struct("i", "left", "right")).alias("pobj"))
    seen = seen.withColumn("by_i", F.col("by.c")).join(objects, [*key, "by_i"], "left")
    whole = tokens.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("i", "text", "lemma", "pos"))).alias("_s"),
        F.map_from_entries(F.collect_list(F.struct(F.col("i"), F.struct("head_i", "dep", "left", "right")))).alias("_t"),
    )
    seen = seen.where(F.col("passive") | F.col("subject").isNotNull()).join(whole, key)
    climb = (
        "aggregate(sequence(1, size(_t)), struct(i as at, false as done), (a, s) -> if(a.done, a, "
        "struct(if(_t[a.at].dep = 'relcl', a.at, _t[a.at].head_i) as at, coalesce(_t[a.at].dep = 'relcl', false) as done)), "
        "a -> if(a.done and _t[a.at].head_i != a.at, _t[_t[a.at].head_i], null))"
    )
    pronoun = F.col("subject.clemma").isin("which", "that", "who", "whom")
    seen = seen.withColumn("noun", F.when(~F.col("passive") & pronoun, F.expr(climb)))
    relative = F.col("noun").isNotNull()
    seen = seen.withColumns({"nl": F.col("noun.left"), "nr": F.col("noun.right")})
    low = F.when(F.col("passive"), F.coalesce("pobj.left", "by.left")).when(relative, F.col("nl")).otherwise(F.col("subject.left"))
    high = F.when(F.col("passive"), F.coalesce("pobj.right", "by.right")).when(relative, F.col("nr")).otherwise(F.col("subject.right"))
    spans = seen.withColumns({"lo": low, "hi": high, "relative": relative})
    part = F.filter("_s", lambda t: (t["i"] >= F.col("lo")) & (t["i"] <= F.col("hi")))
    text = F.array_join(F.transform(part, lambda t: t["text"]), " ")
    lemma = F.array_join(F.transform(F.filter(part, lambda t: ~t["pos"].isin("DET", "PUNCT")), lambda t: t["lemma"]), " ")
    # a by-phrase without an object goes by its own lemma
    lemma = F.when(F.col("passive") & F.col("pobj").isNull(), F.col("by.clemma")).otherwise(lemma)
    return spans.select(
        *key,
        "i",
        F.when(F.col("lo").isNotNull(), text).alias("agent_text"),
        F.when(F.col("lo").isNotNull(), F.when(F.col("relative"), F.lower(text)).otherwise(lemma)).alias("agent_lemma"),
        F.when(F.col("passive"), "passive").otherwise("active").alias("voice"),
        F.when(F.col("passive"), F.col("by").isNotNull()).alias("by_phrase"),
    )


def wanted_agents(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """Agents of wanted verbs (chunk_id, sent_id, verb_lemma, verb_text), at most one row each.

    Candidates are a sentence's tokens of the first of three kinds that has any: verbs of
    that lemma, verbs of that text, any token of that lemma. The first of them with an
    agent or a passive counts; else a participle among them makes an agentless passive.
    """
    key = ["chunk_id", "sent_id"]
    verb = [*key, "verb_lemma", "verb_text"]
    rows = candidates(tokens, wanted.select(*verb).distinct())
    found = rows.join(verb_agents(tokens, verbal=False), [*key, "i"], "left")
    order = Window.partitionBy(*verb).orderBy(F.when(F.col("voice").isNotNull(), 0).when(F.col("tag") == "VBN", 1).otherwise(2), "i")
    first = found.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    participle = F.col("voice").isNull() & (F.col("tag") == "VBN")
    out = first.withColumns(
        {"voice": F.when(participle, "passive").otherwise(F.col("voice")), "by_phrase": F.when(participle, False).otherwise(F.col("by_phrase"))}
    )
    return out.where("voice is not null").select(*verb, "agent_text", "agent_lemma", "voice", "by_phrase")


def parsed_triples(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """triples() of a parser's frames, with the agents found in their sentences."""
    verbs = found.where("syntactic_role = 'patient' and governing_verb is not null")
    said = tokens.join(verbs.select("chunk_id", "sent_id").distinct(), ["chunk_id", "sent_id"], "left_semi")
    agents = wanted_agents(said, verbs.select("chunk_id", "sent_id", F.col("governing_verb").alias("verb_lemma"), "verb_text"))
    return triples(found, agents.withColumnRenamed("verb_lemma", "governing_verb"), ["chunk_id", "sent_id", "governing_verb", "verb_text"])


def triples(frames: DataFrame, agents: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Patient frames with their verb's agent: NO_VERB, AGENTLESS, UNRESOLVED or the agent's category.

    frames: chunk_id, sent_id, governing_verb, verb_i, ...; one row for each patient frame.
    agents: one row each of the columns `on`, or of verb_agents().
    """
    rows = frames.where(F.col("syntactic_role") == "patient")
    if on is None:
        on, agents = ["chunk_id", "sent_id", "verb_i"], agents.withColumnRenamed("i", "verb_i")
    rows = rows.join(agents, on, "left")
    category = (
        F.when(F.col("governing_verb").isNull(), "NO_VERB")
        .when(F.col("voice").isNull(), "UNRESOLVED")
        .when(F.col("agent_text").isNull(), "AGENTLESS")
        .otherwise(agent_category(F.col("agent_text"), F.col("agent_lemma")))
    )
    return rows.withColumns({"agent_category": category, "voice": F.coalesce("voice", F.lit("unknown"))})


def with_language(found: DataFrame, languages: dict[str, str]) -> DataFrame:
    """found with target_language, the language its lemma stands for; null where it stands for none."""
    known = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])
    return found.withColumn("target_language", F.try_element_at(known, F.col("target_lemma")))


def agency(frames: DataFrame, by: list[str]) -> DataFrame:
    """Agency ratio and role counts by group."""
    count = lambda r: F.sum((F.col("syntactic_role") == r).cast("long")).alias(r)
    out = frames.groupBy(*by).agg(*[count(r) for r in ROLE_PRIORITY], F.count(F.lit(1)).alias("total_occurrences"))
    return out.withColumn("agency_ratio", ratio(F.col("agent"), F.col("agent") + F.col("patient"), 0.0))


def inventory_top(frames: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """Most frequent verbs and modifiers by group, as rows of kind, value, n and rank."""
    verbs = frames.where("governing_verb is not null").select(*by, F.lit("verb").alias("kind"), F.col("governing_verb").alias("value"))
    mods = frames.select(*by, F.lit("modifier").alias("kind"), F.explode("modifiers.lemma").alias("value"))
    counts = verbs.unionByName(mods).groupBy(*by, "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, [*by, "kind"], "value", most)


def agency_summary(frames: DataFrame) -> DataFrame:
    """Term, year, agency, occurrences, and the first verb and modifier."""
    by = ["target_term", "doc_year"]
    top = inventory_top(frames, by, 1)
    wide = top.groupBy(*by).agg(
        F.max(F.when(F.col("kind") == "verb", F.col("value"))).alias("top_verb"),
        F.max(F.when(F.col("kind") == "modifier", F.col("value"))).alias("top_modifier"),
    )
    rates = agency(frames, by).select(*by, "agency_ratio", "total_occurrences")
    return rates.join(wide, by, "left")


def weighted_agency(frames: DataFrame, by: list[str]) -> DataFrame:
    """Agency of surface terms averaged by their occurrences, over groups of terms."""
    terms = agency(frames, [*by, "target_term"])
    return terms.groupBy(*by).agg(
        F.sum("total_occurrences").alias("n"),
        (F.sum(F.col("agency_ratio") * F.col("total_occurrences")) / F.sum("total_occurrences")).alias("agency_ratio"),
    )


def top_frames(frames: DataFrame, most: int = 15) -> DataFrame:
    """The first frames of a chunk by role, without repeats of (term, sentence, role), in input order inside a role."""
    again = Window.partitionBy("chunk_id", "target_term", "sentence", "syntactic_role").orderBy("token_idx")
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_PRIORITY.items() for x in kv])[F.col("syntactic_role")], F.lit(4))
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(order, "token_idx"))
    first = frames.withColumn("_again", F.row_number().over(again)).where("_again = 1").drop("_again")
    return first.withColumn("rank", rank).where(F.col("rank") <= most)


def frame_lines(frames: DataFrame) -> DataFrame:
    """(chunk_id, frames) with the chunk's frames as text, from top_frames()."""
    dep = F.when(
        F.length("dep_relation") > 0,
        F.concat(F.lit("(dep: "), "dep_relation", F.coalesce(F.concat(F.lit(", verb: "), "governing_verb"), F.lit("")), F.lit(")")),
    ).otherwise(F.lit(""))
    mods = F.slice("modifiers.text", 1, 3)
    shown = F.when(F.size(mods) > 0, F.concat(F.lit(" [modifiers: "), F.array_join(mods, ", "), F.lit("]"))).otherwise(F.lit(""))
    line = F.concat(F.lit('- "'), "target_term", F.lit('" as '), F.upper("syntactic_role"), dep, shown)
    rows = frames.select("chunk_id", F.struct("rank", line.alias("line")).alias("l"))
    ordered = F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"])
    return rows.groupBy("chunk_id").agg(F.array_join(ordered, "\n").alias("frames"))


def power_triangle(found: DataFrame) -> DataFrame:
    """Triples with a language: count and share of each agent category by era and language."""
    known = found.where(F.col("target_language").isNotNull() & (F.col("agent_category") != "NO_VERB"))
    counts = known.groupBy("era", "target_language", "agent_category").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("era", "target_language")
    return counts.withColumn("proportion", ratio(F.col("n"), F.sum("n").over(whole)))


def power_profiles(found: DataFrame, eras: DataFrame, most: int = 10) -> DataFrame:
    """By era and language: triples with a verb, passives, agentless ones and their share, first agents and first verbs.

    Agents and verbs are name:count, the most frequent first, ties by name, joined by |. An
    era without any such triple keeps one row without a language.
    """
    by = ["era", "target_language"]
    known = found.where(F.col("target_language").isNotNull() & (F.col("agent_category") != "NO_VERB"))
    passive = F.col("voice") == "passive"
    counts = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(passive.cast("long")).alias("passive_count"),
        F.sum((passive & (F.col("agent_category") == "AGENTLESS")).cast("long")).alias("agentless_count"),
    )
    counts = counts.withColumn("agentless_ratio", ratio(F.col("agentless_count"), F.col("passive_count"), 0.0))
    wide = counts.join(listed(known, by, "agent_text", "top_agents", most), by, "left").join(listed(known, by, "governing_verb", "top_verbs", most), by, "left")
    return eras.select("era").distinct().join(wide, "era", "left").unionByName(wide.join(eras, "era", "left_anti"))


def backgrounding(found: DataFrame, by: list[str]) -> DataFrame:
    """Passives, agentless ones and active clauses by group, with two ratios."""
    passive, active = F.col("voice") == "passive", F.col("voice") == "active"
    agentless = passive & (F.col("agent_category") == "AGENTLESS")
    count = lambda c: F.sum(c.cast("long"))
    out = found.groupBy(*by).agg(
        count(passive).alias("passive_count"),
        count(agentless).alias("agentless_count"),
        count(passive & ~agentless).alias("by_phrase_count"),
        count(active).alias("active_count"),
    )
    return out.withColumns(
        {
            "agentless_ratio": ratio(F.col("agentless_count"), F.col("passive_count"), 0.0),
            "passive_rate": ratio(F.col("passive_count"), F.col("passive_count") + F.col("active_count"), 0.0),
        }
    )


def flow_counts(found: DataFrame, top_verbs: int = 10, top_agents: int = 6, least_flow: int = 3) -> DataFrame:
    """Agent category to verb and verb to language flows of the most frequent verbs.

    Agents are those of the largest flows of at least least_flow; verbs are ranked over all agents.
    """
    known = found.where("target_language is not null and governing_verb is not null")
    verbs = known.groupBy(F.col("governing_verb").alias("verb")).agg(F.count(F.lit(1)).alias("n"))
    verbs = verbs.orderBy(F.col("n").desc(), "verb").limit(top_verbs).select("verb")
    rows = known.join(F.broadcast(verbs), known["governing_verb"] == verbs["verb"])
    agents = rows.groupBy("agent_category").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_flow)
    agents = agents.orderBy(F.col("n").desc(), "agent_category").limit(top_agents).select("agent_category")
    left = rows.join(F.broadcast(agents), "agent_category").groupBy(F.col("agent_category").alias("source"), F.col("verb").alias("target"))
    right = rows.groupBy(F.col("verb").alias("source"), F.col("target_language").alias("target"))
    return (
        left.agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit("agent_verb"))
        .unionByName(right.agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit("verb_language")))
    )


def pos_stopwords(frames: DataFrame, content: tuple[str, ...] = ("NOUN", "VERB", "ADJ", "ADV", "PROPN")) -> DataFrame:
    """Lemmas whose most frequent part of speech is not a content one; ties by name."""
    heads = frames.select(F.lower("dep_head_lemma").alias("lemma"), F.col("dep_head_pos").alias("pos"))
    kids = frames.select(F.explode("dep_children").alias("c")).select(F.lower("c.text").alias("lemma"), F.col("c.pos").alias("pos"))
    mods = frames.select(F.explode("modifiers").alias("m")).select(F.lower("m.lemma").alias("lemma"), F.col("m.pos").alias("pos"))
    votes = heads.unionByName(kids).unionByName(mods).where("lemma != ''").groupBy("lemma", "pos").agg(F.count(F.lit(1)).alias("n"))
    first = ranked(votes, ["lemma"], "pos", 1)
    return first.where(~F.col("pos").isin(*content)).select("lemma", "pos", "n")


def flagged_sentences(found: DataFrame, by: list[str], most: int = 5, length: int = 200, terms: tuple[str, ...] = ()) -> DataFrame:
    """The first agentless passives of each group, in input order, cut to `length` characters.

    With terms only those whose whole sentence holds one of them, and the terms found.
    """
    order = Window.partitionBy(*by).orderBy(*[c for c in ("chunk_id", "sent_id", "token_idx") if c in found.columns])
    rows = found.where((F.col("voice") == "passive") & (F.col("agent_category") == "AGENTLESS"))
    if terms:
        rows = rows.withColumn("terms", terms_in_context(F.col("sentence"), terms)).where(F.size("terms") > 0)
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return rows.select(*by, "rank", F.substring("sentence", 1, length).alias("sentence"), *(["terms"] if terms else []))


def terms_in_context(sentence: Column, terms: tuple[str, ...]) -> Column:
    """The terms that occur anywhere in a sentence, sorted; substrings count."""
    low = F.lower(sentence)
    held = [F.when(low.contains(t), F.lit(t)) for t in sorted(terms)]
    return F.filter(F.array(*held), lambda t: t.isNotNull())


def candidates(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """All tokens of each wanted (chunk_id, sent_id, verb_lemma, verb_text) of the first kind that has any.

    Kinds (step): 1 a verb of that lemma, 2 a verb of that text, 3 any token of that lemma.
    """
    key = ["chunk_id", "sent_id"]
    verbal = F.col("pos").isin("VERB", "AUX")
    lemma, text = F.lower("lemma") == F.lower("verb_lemma"), F.lower("text") == F.lower("verb_text")
    step = F.when(lemma & verbal, 1).when(text & verbal, 2).when(lemma, 3)
    rows = wanted.join(tokens.select(*key, "i", "text", "lemma", "pos", "tag"), key).withColumn("step", step).where("step is not null")
    least = F.min("step").over(Window.partitionBy(*key, "verb_lemma", "verb_text"))
    return rows.withColumn("_least", least).where("step = _least").select(*key, "verb_lemma", "verb_text", "i", "step", "tag")


def locate_verbs(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first of the candidates of each wanted verb."""
    first = Window.partitionBy("chunk_id", "sent_id", "verb_lemma", "verb_text").orderBy("i")
    return candidates(tokens, wanted).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def last_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order: the last writer wins. One aggregate, so a key of many rows is combined before it is shuffled."""
    rest = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(rest, order).alias("_last")).select(key, "_last.*")
