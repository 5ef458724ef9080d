"""The judged rules: questions to a scoring model about a paragraph or a sentence, as data.

Every question is a score: its levels run from the worst prose to the best, and the worst is what makes a note.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

REGISTER = "a reader who works in the field"


@dataclass(frozen=True)
class Question:
    id: str
    unit: str
    severity: str
    confidence: str
    instructions: str
    levels: tuple[str, ...]
    message: str
    suggestion: str
    excerpt: str = "all"
    rationale: str | None = None
    flag_level: int = 0

    @property
    def category(self) -> str:
        return self.unit

    def asked(self, register: str) -> dict:
        """The question as a backend gets it."""
        return {"type": "score", "instructions": self.instructions.replace("%{register}", register), "criteria": [{"what": x} for x in self.levels]}


#: Ids, units, grades and the part of a paragraph that a note points at. The wording is our own.
QUESTIONS: tuple[Question, ...] = (
    Question("particulars", "paragraph", "warning", "high", "How much in this paragraph could %{register} check?", ("Nothing: no name, number, date, place or quotation.", "One or two things, the rest general.", "Something in most sentences."), "Nothing in the paragraph can be checked.", "Name the person, number, date or source."),
    Question("wrap-up", "paragraph", "warning", "high", "What does the last sentence do for %{register}?", ("It sums up, draws a moral or hopes.", "It repeats a part with something new.", "It adds a fact or a step."), "The paragraph ends by summing itself up.", "End on the last fact.", "last"),
    Question("throat-clearing", "paragraph", "info", "high", "What does the first sentence do for %{register}?", ("It only says that a topic is coming.", "It announces, and says something too.", "It starts with the matter."), "The paragraph starts by announcing its topic.", "Start with the second sentence.", "first"),
    Question("same-weight", "paragraph", "info", "low", "Can %{register} tell facts, inferences and opinions apart?", ("All are said in the same tone.", "Some are marked.", "Each is marked or plain from its wording."), "Facts and opinions carry the same weight.", "Say what is known and what is thought."),
    Question("self-narration", "paragraph", "info", "medium", "Is this paragraph about its subject or about the document, for %{register}?", ("Most sentences say what the text does or will do.", "Most sentences are about the subject."), "The paragraph describes the document.", "Say the thing that is announced."),
    Question("promotional", "paragraph", "warning", "medium", "How does this paragraph value its subject, for %{register}?", ("It praises only: no measure, no cost.", "It measures, names a cost or does not value."), "The paragraph only praises.", "Give a measure, or what it costs."),
    Question("stock-figure", "sentence", "warning", "high", "Is there a figure of speech in `target`, and whose is it?", ("A stock phrase used for anything.", "A figure with some link to the matter.", "None, or one made for this case."), "A stock figure of speech.", "Say what happens."),
    Question("no-news", "sentence", "warning", "high", "Does `target` tell %{register} anything new?", ("They knew all of it.", "They knew most of it.", "They did not know it."), "The reader knew this.", "Cut it, or add what is new."),
    Question("names-nothing", "sentence", "warning", "high", "What do the nouns and verbs of `target` name?", ("Only abstractions.", "One thing among abstractions.", "Things, people or acts."), "The sentence names no thing.", "Name the thing."),
    Question("ends-on-verdict", "sentence", "info", "high", "How does `target` end?", ("It grades what it just said.", "It ends in a mild judgement.", "It ends in its matter."), "The sentence ends by grading itself.", "Stop before the verdict."),
    Question("trailing-gloss", "sentence", "info", "medium", "Does `target` end in a participle clause that explains it to %{register}?", ("Yes: the clause only interprets.", "No, or the clause adds a fact."), "A trailing clause says what it means.", "Cut the clause, or make it a fact."),
    Question("unnamed-authority", "sentence", "info", "medium", "Who vouches for the claim of `target`, for %{register}?", ("People who can't be found.", "Someone who is named, or nobody is needed."), "The claim rests on nobody in particular.", "Name who said it."),
    Question("stated-stakes", "sentence", "info", "low", "If `target` says that something matters, does %{register} learn why?", ("No reason is given.", "A reason is given, or nothing is said to matter."), "Importance without a reason.", "Say what depends on it."),
    Question("matched-shape", "sentence", "info", "low", "Did its content give `target` its shape? Look at pairs and triples.", ("A pattern came first, words fill it.", "A pattern with real parts.", "The content made the shape."), "A pair or triple for its own sake.", "Keep the part that is true."),
    Question("mirrored-opposites", "sentence", "info", "low", "Do opposite words hold the claims of `target` together, for %{register}?", ("Opposites join claims that are not one comparison.", "None, or one thing is compared."), "Opposites stitch two claims together.", "Make each claim alone."),
    Question("positive-form", "sentence", "info", "low", "Is the point of `target` put to %{register} in the affirmative?", ("What carries the point is a denial.", "The point is affirmed, or it answers a claim that was made before."), "The claim is made by a negative.", "Say what is."),
    Question("name-the-thing", "sentence", "info", "low", "Would %{register} have to look back to know which things `target` means?", ("It points at a thing that has a name.", "It uses the names."), "A pointer in place of a name.", "Use the name."),
    Question("maxim", "sentence", "info", "medium", "Is `target` a saying where %{register} wants a fact?", ("It is a rule about how things always go.", "It is about this case."), "A saying in place of a fact.", "Say what happened here."),
    Question("dressed-pair", "sentence", "info", "low", "Are the facts of `target` dressed as a matched pair?", ("One fact is told as two halves.", "It is told once, or there are two facts."), "One fact dressed as a pair.", "Tell it once."),
    Question("device-before-claim", "sentence", "info", "medium", "Does a device make the claim of `target` within its paragraph, for %{register}?", ("The claim comes through a riddle, a reveal or a contrast.", "The claim is made outright."), "A device makes the claim.", "Make the claim outright."),
)

QUESTION_BY_ID = {q.id: q for q in QUESTIONS}


def select_questions(select: list[str] | None = None, ignore: list[str] | None = None, strict: bool = False) -> list[Question]:
    """As for pattern rules: an id always runs its question, a category those that aren't low unless strict."""
    names = set(QUESTION_BY_ID) | {q.category for q in QUESTIONS}
    if unknown := sorted({*(select or ()), *(ignore or ())} - names):
        raise ValueError(f"unknown questions or categories: {', '.join(unknown)}")
    usual = [q for q in QUESTIONS if strict or q.confidence != "low"]
    chosen = usual if not select else [q for q in QUESTIONS if q.id in select or (q.category in select and q in usual)]
    return [q for q in chosen if q.id not in (ignore or ()) and q.category not in (ignore or ())]


def question_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, q.id, q.unit, q.severity, q.confidence, q.excerpt, q.instructions, list(q.levels), q.message, q.suggestion) for i, q in enumerate(QUESTIONS)]
    return spark.createDataFrame(rows, "ord int, id string, unit string, severity string, confidence string, excerpt string, instructions string, levels array<string>, message string, suggestion string")
