"""The pattern rules. Each is data: what it finds, how much that costs the prose, how sure a match is.

Patterns are in Java's dialect. Gaps that may hard-wrap are possessive loops, so that no text is deep recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tellscan.functions.advice import RATIONALES, SUGGESTIONS
from tellscan.functions.guarded import GUARDED

SEVERITIES, CONFIDENCES = ("error", "warning", "info"), ("high", "medium", "low")

GAP = r"(?:[ \t]|\r?\n(?!\s*\n))++"
WRAP = r"(?:[ \t]|\r?\n(?![ \t]*\r?\n))++"
START = r"(?:\A|[.!?]\s+|\n\s*\n)\s*"
OWN_NOUNS = "framing|formulation|mapping|abstraction"


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    confidence: str
    pattern: str
    message: str
    suggestion: str
    count_group: str | None = None
    skip: tuple[str, ...] = ()
    rationale: str | None = None
    ignore_case: bool = True
    prefix: str = ""
    #: What is passed over in one go where the rule doesn't match; group 2 is empty then.
    idle: str = ""
    #: So many words in a row that must come back in a text with a match.
    echo: int = 0
    #: What every match holds, as a pattern that fails sooner: it begins with a mark.
    hint: str = ""

    @property
    def flags(self) -> str:
        return "(?imdu)" if self.ignore_case else "(?md)"

    @property
    def regex(self) -> str:
        """Group 1 is matched and left out of the note, group 2 is reported."""
        return f"{self.flags}({self.prefix})({self.pattern})" + (f"|{self.idle}" if self.idle else "")


def _rule(id: str, category: str, severity: str, confidence: str, pattern: str, message: str, **more) -> Rule:
    return Rule(id, category, severity, confidence, pattern, message, SUGGESTIONS[id], rationale=RATIONALES[category], **more)


#: The patterns, word lists and grades of the rules.
RULES: tuple[Rule, ...] = (
    _rule("no-x-no-y", "cadence", "warning", "high", r"\bno\s+[\w'-]+,\s+no\s+[\w'-]+(?:,?\s+(?:and\s+)?no\s+[\w'-]+)*+", "A chain of %{count} negated items.", count_group=r"(?i)\bno\b"),
    _rule("did-not-x-did-not-y", "cadence", "warning", "high", r"\b(?:did\s+not|didn't)\s+[\w'-]+(?:,?\s+(?:and\s+)?(?:did\s+not|didn't)\s+[\w'-]+)++", "A chain of %{count} denied actions.", count_group=r"(?i)\b(?:did\s+not|didn't)\b"),
    _rule("and-what-it-should", "closer", "warning", "high", rf",{GAP}(?:and|but|or){GAP}what{GAP}(?:it|they|you|we|he|she|one|i){GAP}(?:(?:should|could|would|must|can|will|might|may)(?:{GAP}not|n['’]t)?|cannot|(?:does|did|is|was|has|have|had|are|were)(?:{GAP}not|n['’]t))[.!]", "An elliptical tail in place of a second claim."),
    _rule("abstract-lives-in", "puffery", "warning", "medium", r"\b(?:work|context|knowledge|answer|value|truth|problem|risk|decision|instructions?|memory|leverage|power|magic|difference|opportunity|insight|advantage|gap|signal|nuance|meaning|tension|friction|complexity|craft|skill|expertise)" + rf"{GAP}(?:that{GAP}|which{GAP})?(?:lives?|lived|sits?|sat){GAP}(?:in|between|inside|outside|beneath|behind|under|underneath)\b", "An abstraction is given a home.", skip=(r"\A[A-Z]",)),
    _rule("sit-with-that", "reader-address", "warning", "high", r"\bsit\s+with\s+(?:that|this|it)\b|" + START + r"(?:but\s+|and\s+|now\s+|so\s+|just\s+)?sit\s+with\s+\S", "The reader is told to sit with something."),
    _rule("hold-onto-that", "reader-address", "warning", "high", START + r"(?:but\s+|and\s+|now\s+|so\s+)?hold\s+(?:on\s+to|onto)\s+(?:that|this)\b", "The reader is told to hold a thought."),
    _rule("cleanly", "self-rating", "warning", "medium", r"\bcleanly\s+(?:in(?:to|\s+(?:two|three|half))|onto)\b", "The text grades its own division."),
    _rule("clean-count", "self-rating", "warning", "high", r"\b(?:two|three|four|five|six|seven|2|3|4|5|6|7)\s+(?:very\s+|fairly\s+|reasonably\s+|pretty\s+)?clean\s+(?:\w+\s+)?(?:parts|halves|pieces|buckets|categories|groups|chunks|sections|layers|camps|cases|classes|clusters|splits|steps|stages|phases|tiers|bands|lanes|axes|dimensions|questions|claims|ideas|moves|jobs|roles)\b", "A counted partition is called clean."),
    _rule("cleanest-x", "self-rating", "error", "high", rf"\bcleanest\s+(?:\w+\s+){{0,2}}(?:{OWN_NOUNS}|comparison|statement|account|argument|idea|definition|summary|reading|take|point|story|explanation|distinction)\b|\bcleanest\s+way\s+to\s+(?:say|put|frame|state|describe|phrase|express|think\s+about)\b", "The text calls its own construction the cleanest."),
    _rule("clean-x", "self-rating", "warning", "medium", rf"\b(?:a|the|one)\s+(?:\w+\s+)?clean\s+(?:\w+\s+)?(?:{OWN_NOUNS}|distinction|through-line|story|answer|argument|split|divide)\b|\bclean\s+(?:line|break|split)\s+between\b", "The text calls its own construction clean."),
    _rule("you-already-know", "reader-address", "warning", "high", r"\byou\s+already\s+know\b", "The reader is told what they know."),
    _rule("is-the-entire", "closer", "warning", "high", r"\bis\s+the\s+entire\s+(?:point|game|thing|business\s+model|deal|story)\b", "A closer that claims to be everything."),
    _rule("the-entire-is", "closer", "warning", "high", r"\bthe\s+entire\s+(?:point|game|thing|business\s+model|deal|story)\s+is\b", "An opener that claims to be everything."),
    _rule("is-real-and-not", "false-concession", "warning", "medium", r"\bis\s+real,?\s+(?:and|but|not)\b", "Something is granted to be real before the turn."),
    _rule("the-punchline-is", "self-rating", "warning", "high", r"\bthe\s+(?:punchline|honest\s+(?:answer|version))\s*(?:is\b|[:?])", "The text announces its own punchline."),
    _rule("worth-naming", "self-rating", "warning", "medium", r"\bworth\s+(?:naming(?:\s+names)?|flagging|separating|spelling\s+(?:it\s+)?out)\b(?!\s+(?:plainly|clearly|bluntly|directly|simply|outright|flatly|straight|up\s+front|out\s+loud)\b)", "The text says what is worth saying.", skip=(r"(?i)naming names",)),
    _rule("worth-saying-plainly", "self-rating", "warning", "high", START + r"(?:(?:it'?s\s+|that'?s\s+)?(?:worth|better|best|easier|simpler|fairer|clearer)\s+(?:saying|stating|putting|naming|flagging|separating|said|stated|put|spelling\s+(?:it\s+)?out)\s+(?:it\s+|this\s+|that\s+)?(?:plainly|clearly|bluntly|directly|simply|outright|flatly|straight|up\s+front|out\s+loud)|(?:put|said|stated)\s+(?:it\s+|this\s+|that\s+)?(?:plainly|bluntly|flatly|outright))\b", "The text praises its own plainness."),
    _rule("not-nothing", "false-concession", "warning", "high", rf"\b(?:(?:i|he|she|we|you|they|there){WRAP})?(?:am|is|are|was|were){WRAP}not{WRAP}nothing\b|\b[\w-]+['’]s{WRAP}not{WRAP}nothing\b", "A double negative in place of a measure.", skip=(r"(?i)\A(?:i|he|she|we|you|they|there)\b",)),
    _rule("impact-noun-bare", "borrowed-metaphor", "warning", "medium", r"\b(?:(?:measur|assess|consider|understand|understood|evaluat|gaug|weigh|quantif|track|examin|explor|maximi[sz])\w*\s+(?:the|its|their|our|this|that)\s+impacts?|the\s+impacts?\s+of)\b(?!-)(?!\s+(?:statements?|assessments?|reports?|studies|study|analys[ie]s|evaluations?|factors?|ratings?|scores?|investing|investors?|funds?|bonds?|craters?|wrench(?:es)?|drivers?|sockets?|printers?|sprinklers?|resistan(?:t|ce)|tested|testing|velocit(?:y|ies)|forces?|energy|load(?:s|ing)?|zones?|points?|players?|sites?|angles?|damage|absorbers?)\b)", "Impact stands for an effect that isn't named."),
    _rule("thats-how-x", "closer", "warning", "high", START + r"(?:that|this)(?:'s| is)\s+how\b", "A sentence that only points back."),
    _rule("announced-takeaway", "self-rating", "warning", "high", START + r"(?:here'?s\s+)?the\s+(?:loop|pattern|trick|lesson|takeaway|playbook|framing|insight|kicker)\b[^.!?\n]{0,60}:", "The takeaway is announced."),
    _rule("is-is", "cadence", "warning", "high", r"\bis,?\s+is\b", "A doubled copula."),
    _rule("earns-its-place", "self-rating", "warning", "high", r"\b(?:earns?|earned|earning)\s+(?:its|their|his|her)\s+(?:place|keep)\b", "The text says that a part deserves to be there."),
    _rule("does-a-lot-of-work", "self-rating", "warning", "high", r"\b(?:does|do|doing|did)\s+a\s+lot\s+of\s+(?:heavy\s+lifting\b|work\s+(?:here|in\s+th(?:at|is))\b)", "A word is said to work hard."),
    _rule("failure-mode-here", "borrowed-metaphor", "warning", "high", r"\bthe\s+failure\s+mode\s+here\s+is\b", "An engineering phrase for a plain mistake."),
    _rule("thats-the-tension", "closer", "warning", "high", START + r"(?:and\s+|so\s+|but\s+)?(?:that|this)(?:'s|’s|\s+is)\s+the\s+(?:tension|bet)\s*(?:[.!?:;—]|\z)", "A closer that names a tension."),
    _rule("right-up-until", "closer", "warning", "high", r"\bright\s+up\s+until\s+it\s+(?:doesn'?t|isn'?t|stops|breaks)\b", "A reversal saved for the end."),
    _rule("two-things-true", "false-concession", "error", "high", r"\b(?:two|both)\s+things\s+(?:can\s+(?:both\s+)?be|are)\s+true\b", "A concession by formula."),
    _rule("notice-what-there", "reader-address", "warning", "high", START + r"(?:notice\s+what\b[^.!?\n]{0,40}\b(?:did|does|just\s+did)\s+there\b|read\s+that\s+again\b)", "The reader is told to look again."),
    _rule("none-of-this-is-to-say", "false-concession", "error", "high", r"\bnone\s+of\s+(?:this|that|the\s+above)\s+is\s+to\s+say\b", "A disclaimer by formula."),
    _rule("if-im-being-honest", "false-concession", "warning", "medium", r"\bif\s+(?:I['’]?m|I\s+am|we['’]?re|we\s+are)\s+(?:being\s+)?honest\b|\bhonestly,\s+the\s+(?:answer|truth)\b", "Candour is announced."),
    _rule("honestly", "self-rating", "warning", "high", r"\b(?!(?:and|but|or|nor|yet|so|then|though|although|because|if|quite|more|most|very|really|pretty|fairly|too|also|just|only|now|again|well|i|we|you|he|she|they|it)\b)\w+\b[ \t]+honestly[ \t]*(?=[.,;!])", "A verb is graded honest."),
    _rule("honest-x", "self-rating", "warning", "high", rf"\b(?:an|the|one|this|that)[ \t]+(?:(?!most\b|more\b)\w+[ \t]+)?honest[ \t]+(?:\w+[ \t]+)?(?:{OWN_NOUNS}|comparison|accounting|through-line)\b", "The text calls its own construction honest."),
    _rule("most-honest-x", "self-rating", "error", "high", rf"\bmost[ \t]+honest[ \t]+(?:(?!way\b)\w+[ \t]+){{0,2}}(?:{OWN_NOUNS}|comparison|accounting|assessment|appraisal|reading|account|answer|version|summary|take|signal|through-line)\b|\bmost[ \t]+honest[ \t]+way[ \t]+to[ \t]+(?:say|put|frame|state|describe|phrase|think[ \t]+about)\b", "The text calls its own construction the most honest."),
    _rule("genuinely", "self-rating", "info", "low", r"\bgenuinely\b", "A marker of sincerity."),
    _rule("and-thats-fine", "false-concession", "warning", "medium", START + r"and\s+that['’]?s\s+(?:fine|okay|ok)\s*[.!]", "A permission nobody asked for."),
    _rule("puffery-words", "puffery", "error", "high", r"\b(?:boasts\s+a\b|vibrant|nestled\b(?:\s+\S+){0,2}?\s+(?:in|among|between)\b|in\s+the\s+heart\s+of\s+(?:the\s+\w+|downtown\b|(?-i:[A-Z])\w+)|groundbreaking|renowned|diverse\s+array|breathtaking|natural\s+beauty|indelible\s+mark|deeply\s+rooted|stands\s+as\s+a\s+testament|rich\s+(?:history|cultural|heritage))", "Brochure vocabulary."),
    _rule("stands-serves-as", "puffery", "warning", "medium", r"\b(?:stands|serves)\s+as\b|\bis\s+a\s+(?:testament|reminder)\s+to\b", "A grand verb for is."),
    _rule("vital-role", "puffery", "error", "high", r"\bplays?\s+a\s+(?:vital|crucial|pivotal|significant|key|central)\s+role\b", "A role is graded and not described."),
    _rule("underscores-highlights", "puffery", "warning", "medium", rf"\bunderscor(?:ed|ing)\b|\bunderscores?{WRAP}(?:a|an|the|its|his|her|their|our|your|my|this|that|these|those|what|why|how|just)\b|\b(?:highlights|emphasizes)\s+(?:its|the|their)\s+(?:importance|significance)\b", "Emphasis in place of evidence."),
    _rule("rich-tapestry", "puffery", "error", "high", r"\brich\s+tapestry\b|\btapestry\s+of\b", "A stock figure for variety."),
    _rule("rule-of-three", "cadence", "info", "low", r"(?<![\w'-])[\w'-]+,\s+[\w'-]+,\s+(?:and\s+)?[\w'-]+[.!?]", "Three single words close a sentence.", ignore_case=False, prefix=r"(?:\A|(?<=[^,\s]))\s*"),
    _rule("em-dash", "punctuation", "info", "medium", "—", "An em dash.", ignore_case=False),
    _rule("em-dash-overuse", "punctuation", "warning", "high", r"—[^\n—]*+(?:\n(?!\s*\n)[^\n—]*+)*+—[^\n—]*+(?:\n(?!\s*\n)[^\n—]*+)*+—(?:[^\n—]*+(?:\n(?!\s*\n)[^\n—]*+)*+—)*+", "Three or more em dashes in a paragraph.", ignore_case=False),
    _rule("question-isnt", "false-correction", "warning", "medium", r"\bthe\s+question\s+is(?:n['’]?t|\s+not)\s+(?:whether|if|how|what|why|who)\b[^.!?\n]{0,80}?,\s*(?:it['’]?s|but)\b", "A question is refused to put another."),
    _rule("less-about-more-about", "false-correction", "warning", "medium", r"\b(?:it['’]?s|it\s+is|this\s+is|that['’]?s|that\s+is)\s+less\s+about\s+[^.!?\n]{1,60}?\b(?:(?:and\s+|,\s*)?more\s+about|than\s+about)\b", "A contrast by formula."),
    _rule("vague-attribution", "false-concession", "error", "high", r"\bsome\s+(?:critics|experts|observers|scholars|analysts)\s+(?:argue|say|believe|contend|maintain)\b|\bit\s+is\s+widely\s+(?:regarded|considered|seen|believed|acknowledged)\b|\bmany\s+would\s+argue\b", "A claim of nobody in particular."),
    *(_rule(**arguments) for arguments in GUARDED),
)

BY_ID = {r.id: r for r in RULES}
CATEGORIES = sorted({r.category for r in RULES})


def select_rules(select: list[str] | None = None, ignore: list[str] | None = None, strict: bool = False) -> list[Rule]:
    """An id always runs its rule, a category its rules that aren't low unless strict; without either, all of those.

    ignore takes away by id or category. A name that is neither is an error.
    """
    if unknown := sorted({*(select or ()), *(ignore or ())} - set(BY_ID) - set(CATEGORIES)):
        raise ValueError(f"unknown rules or categories: {', '.join(unknown)}")
    usual = [r for r in RULES if strict or r.confidence != "low"]
    chosen = usual if not select else [r for r in RULES if r.id in select or (r.category in select and r in usual)]
    return [r for r in chosen if r.id not in (ignore or ()) and r.category not in (ignore or ())]


def explain(name: str) -> dict:
    """All that is known of a pattern rule or, if there is none of that name, a judged one; another name is an error."""
    from tellscan.functions.examples import CASES
    from tellscan.functions.questions import QUESTION_BY_ID

    if name in BY_ID:
        r = BY_ID[name]
        return {"id": r.id, "category": r.category, "severity": r.severity, "confidence": r.confidence, "message": r.message, "why": r.rationale, "fix": r.suggestion, "noted": [CASES[name][0]], "not noted": [CASES[name][1]]}
    if name in QUESTION_BY_ID:
        q = QUESTION_BY_ID[name]
        return {"id": q.id, "category": q.category, "severity": q.severity, "confidence": q.confidence, "message": q.message, "why": q.rationale, "fix": q.suggestion, "question": q.instructions, "levels": list(q.levels)}
    raise ValueError(f"unknown rule: {name}")


def explained(name: str) -> str:
    """explain() as lines of text; examples stand indented, with their line breaks and tabs spelt out."""
    out = []
    for label, value in explain(name).items():
        if isinstance(value, list):
            out += [f"{label}:", *("    " + x.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") for x in value)]
        elif value is not None:
            out.append(f"{label}: {value}")
    return "\n".join(out)


def rules_table() -> str:
    """A line for each pattern rule, in columns."""
    rows = [(r.id, r.category, r.severity, r.confidence, r.message) for r in RULES]
    wide = [max(len(row[i]) for row in rows) for i in range(4)]
    return "\n".join("  ".join([*(x.ljust(w) for x, w in zip(row, wide, strict=False)), row[4]]) for row in rows)


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, r.id, r.category, r.severity, r.confidence, r.message, r.suggestion, r.rationale) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "ord int, id string, category string, severity string, confidence string, message string, suggestion string, rationale string")
