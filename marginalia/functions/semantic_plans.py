"""What a question about a document asks, of which parts of it: mode, slots, objects, and which slot goes with which objects."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marginalia.functions import spans

# The words by which modes, slots and objects are known. A slot of the first group needs one of its leads before it or a tail behind it; of a pair either names both.
TUTOR = r"(?iU)\b(?:как\s+репетитор|как\s+препод\w*|объясни\s+(?:простым\s+языком|как\s+для\s+студента|по\s+простому))\b"
COMPARE = r"(?iU)\b(?:сравн(?:и|ить)|сопостав(?:ь|ить)|отличи[яе]|различи[яе])\b"
TAIL = r"\s+(?:исслед|работ)\w*"
FORMS = {"object": r"объект\w*", "subject": r"предмет\w*", "goal": r"цел(?:ь|и|ью|ей)", "tasks": r"задач\w*"}
LEADS = {"object": r"кто\s+", "subject": r"что\s+является\s+", "goal": r"как\s+сформулирован\w*\s+", "tasks": r"(?:какие|как\s+сформулирован\w*)\s+"}
PAIRS = [("object", "subject"), ("goal", "tasks")]
OTHERS = {"relevance": r"актуал(?:ьн|изир)\w*", "hypothesis": r"гипотез\w*", "conclusions": r"вывод\w*(?=\s+по\s+(?:глав|раздел|параграф|част))|главн\w+\s+вывод\w*"}
SLOTS = [*FORMS, *OTHERS]
OBJECTS = {"section": r"(?:под)?раздел\w*|глав\w*|параграф\w*|пункт\w*|§|section|chapter|clause", "table": r"табл(?:иц\w*|\.)?|table", "figure": r"рис(?:ун\w*|\.)?|figure|fig\.?"}
INTRO = r"введен\w*"
NUMBER = r"\p{L}?\d+(?:[.,]\d+)*"
JOINED = r"\s*(?:,|-|–|—|\bи\b)\s*"
#: Chapters whose conclusions are meant if none is named.
CONCLUDED = ["1", "2"]

OBJECT = "array<struct<at:int,kind:string,key:string>>"


def patterns() -> dict[str, str]:
    """All patterns by the kind of their spans; '+' joins the slots of a pair."""
    word = lambda p: rf"(?iU)(?<![\p{{L}}\d])(?:{p})"
    out = {"+".join(pair): word(rf"{FORMS[pair[0]]}\s+и\s+{FORMS[pair[1]]}(?:{TAIL})?") for pair in PAIRS}
    out |= {slot: word(rf"{LEADS[slot]}{form}(?:{TAIL})?|{form}{TAIL}") for slot, form in FORMS.items()}
    out |= {slot: word(p) for slot, p in OTHERS.items()}
    out |= {kind: word(rf"(?:{p})\s*(?:№\s*)?{NUMBER}(?:{JOINED}{NUMBER})*") for kind, p in OBJECTS.items()}
    # 'в 1 и 2 главе' names sections too
    out["section"] += rf"|(?<=\bв\s)\d+(?:{JOINED}\d+)?\s+глав\w*"
    return out | {"intro": word(INTRO)}


def _objects(span: Column) -> Column:
    """The objects that a span names: sections from one number to another are all between, as are those at 'and'; tables and figures are those named."""
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(span["text"], r"(?iU)^(?:\p{L}+\.?|§)\s*(?:№\s*)?(?=\p{L}?\d)", ""), F.lit(rf"(?U){NUMBER}"), F.lit(0)), lambda n: F.upper(F.replace(n, F.lit(","), F.lit("."))))
    whole = lambda k: F.get(numbers, F.lit(k)).try_cast("int")
    # at most a hundred chapters: a year behind a chapter is no range
    ranged = F.when((F.size(numbers) == 2) & whole(0).isNotNull() & (whole(1) >= whole(0)) & (whole(1) - whole(0) < 100), F.transform(F.sequence(whole(0), whole(1)), lambda k: k.cast("string")))
    keys = F.when(span["kind"] == "intro", F.array(F.lit("intro"))).when(span["kind"] == "section", F.coalesce(ranged, numbers)).otherwise(numbers)
    kind = F.when(span["kind"] == "intro", "section").otherwise(span["kind"])
    return F.transform(keys, lambda key: F.struct(span["start"].alias("at"), kind.alias("kind"), key.alias("key")))


def plan(question: Column) -> Column:
    """struct(mode, slots, objects, bound) of a question.

    mode is tutor_overview, compare_objects or generic. slots are in the order of their places. objects
    are (at, kind, key), each once: the sections, then tables, then figures; asked for slots without any
    section, the introduction comes first, and conclusions add chapters 1 and 2. bound is what each slot
    is about: the objects behind it up to the next slot, else the sections of the whole question.
    Of names that overlap the longest that begins first counts.
    """
    q = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " "))
    all_spans = spans.of_patterns(q, patterns())
    mode = F.when(q.rlike(TUTOR), "tutor_overview").when(q.rlike(COMPARE), "compare_objects").otherwise("generic")
    kinds = [*OBJECTS, "intro"]
    # each step is bound once: written into the next one it would be computed again for each use
    return F.element_at(F.transform(F.array(F.struct(all_spans.alias("spans"), mode.alias("mode"))), lambda x: _of_spans(x["spans"], x["mode"], kinds)), 1)


def _bound_once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _of_spans(found: Column, mode: Column, kinds: list[str]) -> Column:
    told = F.filter(found, lambda s: ~s["kind"].isin(*kinds))
    placed = F.flatten(F.transform(told, lambda s: F.transform(F.split(s["kind"], r"\+"), lambda slot: F.struct(s["start"].alias("at"), slot.alias("slot")))))
    named = F.flatten(F.transform(F.filter(found, lambda s: s["kind"].isin(*kinds)), _objects))

    def with_both(x: Column) -> Column:
        slots, objects = x["slots"], x["objects"]
        asked = F.array_distinct(F.transform(slots, lambda s: s["slot"]))
        has_section = F.exists(objects, lambda o: o["kind"] == "section")
        tutor = (x["mode"] == "tutor_overview") & has_section & ~F.arrays_overlap(asked, F.lit(["goal", "tasks", "conclusions"]))
        asked = F.when(tutor, F.array_union(asked, F.lit(["goal", "tasks", "conclusions"]))).otherwise(asked)
        return _bound_once(F.struct(asked.alias("asked"), x["slots"].alias("slots"), x["objects"].alias("objects"), x["mode"].alias("mode"), has_section.alias("has_section")), finish)

    def finish(x: Column) -> Column:
        none = F.array().cast(OBJECT)
        section = lambda key: F.struct(F.lit(0).alias("at"), F.lit("section").alias("kind"), F.lit(key).alias("key"))
        intro = F.when((F.size(x["asked"]) > 0) & ~x["has_section"], F.array(section("intro"))).otherwise(none)
        concluded = F.when(F.array_contains(x["asked"], "conclusions"), F.array(*map(section, CONCLUDED))).otherwise(none)
        of = lambda kind: F.filter(x["objects"], lambda o: o["kind"] == kind)
        intros = F.filter(of("section"), lambda o: o["key"] == "intro")
        rest = F.filter(of("section"), lambda o: o["key"] != "intro")
        named = F.concat(intro, intros, rest, concluded, of("table"), of("figure"))
        bare = F.array_distinct(F.transform(named, lambda o: F.struct(o["kind"].alias("kind"), o["key"].alias("key"))))
        sections = F.filter(bare, lambda o: o["kind"] == "section")

        def about(s: Column) -> Column:
            behind = F.filter(x["slots"], lambda t: t["at"] > s["at"])
            until = F.coalesce(F.array_min(F.transform(behind, lambda t: t["at"])), F.lit(2147483647))
            own = F.transform(F.filter(x["objects"], lambda o: (o["at"] > s["at"]) & (o["at"] < until)), lambda o: F.struct(o["kind"].alias("kind"), o["key"].alias("key")))
            return F.transform(F.when(F.size(own) > 0, F.array_distinct(own)).otherwise(sections), lambda o: F.struct(s["slot"].alias("slot"), o["kind"].alias("kind"), o["key"].alias("key")))

        added = F.transform(F.array_except(x["asked"], F.transform(x["slots"], lambda s: s["slot"])), lambda s: F.struct(F.lit(2147483647).alias("at"), s.alias("slot")))
        bound = F.array_distinct(F.flatten(F.transform(F.concat(x["slots"], added), about)))
        return F.struct(x["mode"].alias("mode"), x["asked"].alias("slots"), bare.alias("objects"), bound.alias("bound"))

    return _bound_once(F.struct(placed.alias("slots"), named.alias("objects"), mode.alias("mode")), with_both)
