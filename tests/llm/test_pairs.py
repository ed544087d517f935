from collections import Counter

import pytest

from asclera.llm import pairs as D
from asclera.llm.languages import Languages, language_of_tag

EN = ["What are the side effects of this medicine in older adults and how long does the treatment take to work for the pain", "My doctor told me to take the tablets with food and to come back when it does not help", "Can I stop the medicine or is it safe to go on with it every day"]
FR = ["Quels sont les effets indésirables de ce médicament chez les personnes âgées et combien de temps faut-il le prendre", "Mon médecin m'a dit de prendre les comprimés avec un repas et de revenir si cela ne suffit pas", "Peut-on arrêter le traitement ou faut-il continuer tous les jours"]
DE = ["Welche Nebenwirkungen hat dieses Mittel bei älteren Menschen und wie lange muss man es einnehmen", "Mein Arzt sagte ich solle die Tabletten mit dem Essen nehmen und wiederkommen wenn es nicht hilft", "Kann man das Mittel absetzen oder ist es sicher es jeden Tag zu nehmen"]
LANGS = Languages([(t, x) for t, xs in (("en", EN), ("fr", FR), ("de", DE)) for x in xs], least=1)


def answers():
    names = ["zolpamine", "grefatine", "mosartane", "belidine", "traxomine", "verapine", "doxatine", "lumazine"]
    ills = ["gretitis", "molosis", "fanemia", "dritosis", "plemitis", "corsemia"]
    for k in range(160):
        n, i = names[k % 8], ills[k % 6]
        yield k, [f"What are the side effects of {n} in older adults?", f"Can {i} come back once you stop {n}?", f"How long does {n} take to work for {i}?", f"Side effects of {n}"][k % 4]


ENDINGS = D.Endings(list(answers()), known_share=0.24)
LOOKS = D.Refusals({}, 0, 0)  # nothing learned: looks decide


@pytest.mark.parametrize("text", [None, "", "  ", "​", " \n", "N/A", "n.a.", "[no answer]", "...", "-", "?", "NONE", "null"])
def test_empty(text):
    assert D.is_empty(D.visible(text))


@pytest.mark.parametrize(
    ("text", "is_"),
    [
        ("I'm sorry, but I can’t help with medical questions.", True), ("AS A LANGUAGE MODEL, I CANNOT ANSWER THIS.", True), ("I must decline to rewrite this.", True), ("This goes beyond what I am allowed to do.", True), ("I don't feel comfortable summarizing this.", True),
        ("My guidelines prevent me from discussing it.", True), ("It would not be appropriate for me to respond.", True), ("Unfortunately this is something I'm unable to comment on.", True), ("Je ne peux pas répondre à cette question.", True), ("No puedo ayudar con esa solicitud.", True), ("NO ANSWER CAN BE GIVEN HERE FOR SAFETY REASONS; CONTACT A DENTIST.", True), ("This question cannot be answered.", True),
        ("Why would a doctor refuse to prescribe x for y?", False), ("Sorry for the delay. What helps with pain?", False), ("I have x and cannot sleep because of pain; could y be the cause?", False), ("Can I stop x?", False), ("What if I can't swallow x?", False), ("Ich kann nachts nicht schlafen", False),
    ],
)
def test_refusal(text, is_):
    assert D.looks_like_refusal(text) is is_


@pytest.mark.parametrize(
    ("text", "off"),
    [
        ("What are the side effects of zolpamine in older adults", False), ("Side effects of zolpamine", False), ("Can gretitis come back once you stop belidine", False), ("How long does verapine take to work for fanemia?", False),
        ("What are the side effects of", True), ("What are the side effects of zolpamine in", True), ("Can gretitis come back once you st", True), ("What are the side effects of zolpamine in older-", True), ("How long does verapine take…", True), ("Can molosis come back once you stop belidine? How long does", True), ("Can molosis come back,", True), ("", False),
    ],
)
def test_breaks_off(text, off):
    assert ENDINGS.breaks_off(text) is off


def test_copy_shares():
    q = " ".join(f"w{i}" for i in range(40))
    half = " ".join(f"w{i}" for i in range(8, 30))
    near = " ".join(f"w{i}" if i % 9 else "oops" for i in range(40))
    got = D.copied_shares([q, q, q, q, "a b", ""], [q, half, near, " ".join(f"w{i}" for i in range(12)), "a b", "x"])
    assert got[0] == 1 and got[1] == pytest.approx(22 / 40) and got[2] > 0.8 and got[3] < 0.47 and got[4] == 1 and got[5] == 0
    assert D.copied_shares(["Gretitis?", "Stop it", "a b c"], ["gretitis", "Do not stop it", "a b d"]).tolist() == [1, 0, 0]


def test_defects(spark):
    q = EN[0] + ". " + EN[1]
    rows = [
        ("m", 1, q, "What are the side effects of zolpamine in older adults?"), ("m", 2, q, None), ("m", 3, q, FR[0]), ("m", 4, q, q.upper()), ("m", 5, q, "Can gretitis come back once you st"), ("m", 6, q, "I cannot help with that."), ("m", 7, None, FR[0] + "?"), ("m", 8, "  ", "N/A"),
        ("m", 9, FR[1], FR[0] + "?"), ("m", 10, FR[1], EN[2] + "?"), ("m", 1, q, "What are the side effects of zolpamine in older adults?"), ("m", 2, q, None), ("m", 11, q, q * 200),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "source string, id long, prompt string, response string, defect string")
    got = {(r.source, r.id): r.defect for r in D.defective_pairs(df, LANGS, ENDINGS, LOOKS).collect()}
    assert got == {("m", 2): "empty", ("m", 3): "other_language", ("m", 4): "copy", ("m", 5): "truncated", ("m", 6): "refusal", ("m", 8): "empty", ("m", 10): "other_language", ("m", 11): "copy"}
    assert D.defective_pairs(df.where("false"), LANGS, ENDINGS, LOOKS).count() == 0


def test_endings_are_counted_over_all_responses_and_less_the_texts_own(spark):
    rows = [("m", k, k, "the prompt", t) for k, t in answers()] + [("m", 0, 0, "the prompt", next(answers())[1])]
    rows += [("r", k, k, None, f"Common words here number {k}.") for k in range(13_000)] + [("r", 20_000, 1, None, "Side effects of"), ("r", 20_001, 2, None, "")]
    e = D.fit_endings(spark.createDataFrame(rows, "source string, id long, group long, prompt string, response string"))
    assert e.counts["^ side effects of"] == (1, 41) and e.counts["of"] == (1, 81)  # as many as there are, none left out
    assert e.breaks_off("Side effects of") and {"prompt", "zolpamine"} <= e.whole and "number" in e.known
    own = e.tally(Counter(e.sequences(*D.sentences_of("Side effects of"))).items())
    assert own["^ side effects of"] == (1, 1)


def test_a_batch_without_defects(spark):
    df = spark.createDataFrame([("m", 1, EN[0], "What are the side effects of zolpamine in older adults?")], "source string, id long, prompt string, response string")
    assert D.defective_pairs(df, LANGS, ENDINGS, LOOKS).count() == 0


DECLINE = ["I'm sorry, but I can't help with medical questions.", "As a language model, I cannot answer this.", "I must decline to rewrite this question because it concerns {n}.", "Sorry, I can't assist with that request.", "My guidelines prevent me from discussing {n}.", "It would not be appropriate for me to respond to questions about {i}.", "I am not able to provide health advice. Please see a professional."]
ASK = ["My doctor said I cannot provide samples for {i}, why?", "I am unable to answer calls because of {i}; does {n} help?", "Can {i} come back once you stop {n}?", "What are the side effects of {n} in older adults?", "How long does {n} take to work for {i}?", "My mother has {i} and takes {n}, what helps?", "Is it safe to take {n} when I have {i}?", "My doctor said I should take {n} because of {i}, why?", "Why did my doctor send samples for {i}, and does {n} help?", "Who takes calls about {i} because of {n}; does it help?"]


def test_refusals_are_learned_from_the_responses(spark):
    rng = __import__("random").Random(3)
    word = lambda end: "".join(rng.choices("bcdfglmnprst", k=3)) + rng.choice("aeiou") + "".join(rng.choices("blmnrt", k=2)) + end
    made = [rng.choice(DECLINE if rng.random() < 0.1 else ASK[2:] if k < 2000 or k % 10 else ASK).format(n=word("ine"), i=word("osis")) for k in range(4000)]
    rows = [("m", k, "a prompt", t) for k, t in enumerate(made[:2000])] + [("m", 1, "a prompt", made[1]), ("m", 9000, None, None), ("m", 9001, "x", "")]
    refuses = D.fit_refusals(spark.createDataFrame(rows, "source string, id long, prompt string, response string"))
    starts = tuple(d.split("{")[0] for d in DECLINE)
    held_out = [(t, t.startswith(starts)) for t in made[2000:]]
    found = [refuses(t) for t, _ in held_out]
    right = sum(f and is_ for f, (_, is_) in zip(found, held_out, strict=True))
    assert right == sum(found) == sum(is_ for _, is_ in held_out) > 100  # precision and recall 1 on responses not seen
    assert refuses("I cannot answer that.") and refuses("Sorry, this question concerns things that my guidelines prevent me from.")
    q = "My doctor said I cannot provide urine samples, why?"
    assert D.looks_like_refusal(q) and not refuses(q) and not refuses("I can't help with this", "I can't help with this heavy bag any more")
    assert D.fit_refusals(spark.createDataFrame(rows, "source string, id long, prompt string, response string").where("false")).learned is False


def test_tags_and_languages():
    assert [language_of_tag(t) for t in ("EN", "en-US", "fra", "und", None, "", "gr")] == ["en", "en", "fr", None, None, None, "el"]
    assert LANGS.best([EN[1], FR[1], DE[1]]) == ["en", "fr", "de"] and LANGS.scores(["", "123"]).tolist() == [[0, 0, 0]] * 2
