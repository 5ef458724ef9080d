"""The pattern rules with look-around, back-references or a dropped prefix, as arguments for a Rule.

A prefix is matched before the pattern and left out of the note. It is group 1 and the reported text group 2, so a
pattern's own groups count from 3. Loops over alternatives without a small bound are possessive.
"""

from __future__ import annotations

#: Fixed values from here on: fragments, word lists, patterns and grades of the rules.
GAP = r"(?:[ \t]|\r?\n(?!\s*\n))++"
WRAP = r"(?:[ \t]|\r?\n(?![ \t]*\r?\n))++"
INDENT = r"(?:[ \t]|\r?\n(?!\s*\n)[ \t]{0,4})++"
BREAK = r"\r?\n[ \t ]*\r?\n"
ONE_NB = rf"(?:[ \t ]|(?!{BREAK})\r?\n)"
NB = ONE_NB + "++"
LETTER = r"\p{L}\p{M}\p{Nd}\p{Pc}"
BLANK = r"\p{IsWhite_Space}"
CLOSERS = (
    rf"(?i:point|game|thing|deal|story|ballgame|ball{NB}game|(?:value|fix)(?=[^{LETTER}{BLANK}'’-]|{NB}(?:[^{LETTER}{BLANK}*_`\"'‘“(\[{{~]|\d+[.)][ \t])"
    rf"|{ONE_NB}*+(?:\z|{BREAK}|(?:of|to|for|in|on|at|with|here|there|behind|right|though|now|anyway|really|from|over|after|and|but|so|as|that|which|if|when|because|since|unless|until|once|while|where"
    r"|i|we|you|he|she|it|they|the|a|an|this|these|those|every|any|my|our|your|his|her|their|its)\b)))"
)
LONG_START = r"(?:^|(?<=[.!?])[ \t]{1,2})"
LONG_PART = r"(?:[^.!?\n\s]|(?<![ \t])[ \t]{1,2}(?![ \t])|\r?\n(?!\s*\n)[ \t]*)"
SIXTY = LONG_START + LONG_PART + r"{60,}+[.!?][ \t]{1,2}"
#: A sentence that is too short, or not followed as the rule asks: what begins in its midst ends where it ends, so it is passed over.
OTHER_SENTENCE = LONG_START + LONG_PART + "++"
REAL_NEXT = "and|but|or|nor|yet|too|enough|itself|indeed|which|that|here|there|so|time|world|numbers?|roots?|money|estate|user"
HEADS = "reason|problem|question|lesson|difference|trick|move|goal|tell|pattern|insight|takeaway|shift|bet|catch|bottleneck|issue|game|cause|failure|magic|challenge|tension|irony|paradox|trap"
WHOLE_NOUNS = "tell|point|game|story|trick|question|problem|issue|lesson|job|work|move|test|signal|difference|answer|risk|goal|reason|pattern|insight|takeaway|shift|bet|win|catch|gap|bottleneck|value|skill|challenge|fix"
EQUATED = "tell|point|question|problem|issue|lesson|difference|trick|move|risk|goal|reason|pattern|insight|takeaway|shift|bet|catch|gap|bottleneck|failure|mistake|secret|magic|challenge|tension|trap"
BULLET = r"(?:[-*+•][ \t]+|\d+[.)][ \t]+)?"
SENTENCE = r"(?:^|(?<=[.!?])[ \t]{1,2})"
OPENING = r"(?:\A|[.!?]\s+|\n\s*\n)\s*"
PARAGRAPH_END = r"(?=[ \t]*(?:\r?\n[ \t]*(?:\r?\n|\z)|\z))"
COPULA = r"(?:\bis|\bare|\bwas|\bwere|\bisn['’]t|\baren['’]t|\bwasn['’]t|\bweren['’]t|\bit['’]s|\bthat['’]s|\bthis\s+is|\bthese\s+are|\bthose\s+are)"
ARTICLE = r"(?:a\s+|an\s+|the\s+)?"
BUILDING = "(?:wall|column|beam|post|pillar|joist|stud|masonry|partition|structure|frame|footing|foundation|member)s?"
IMPACT_COMPOUND = r"(?!\s+(?:statements?|assessments?|reports?|studies|study|analys[ie]s|evaluations?|factors?|ratings?|scores?|investing|investors?|funds?|bonds?|craters?|wrench(?:es)?|drivers?|sockets?|printers?|sprinklers?|resistan(?:t|ce)|tested|testing|velocit(?:y|ies)|forces?|energy|load(?:s|ing)?|zones?|points?|players?|sites?|angles?|damage|absorbers?)\b)"
IMPACTED = "(?:tooth|teeth|molars?|bowels?|colon|fractures?|soils?)"
AUXILIARY = r"(?:(?:is|are|was|were|be|been|being|am|has|have|had|having|does|do|did|can|could|will|would|shall|should|must|may|might|ought|ain)(?![\w'’-])|\w+n['’]t(?![\w'’-]))"
QUIP_AUXILIARY = r"(?:is|are|was|were|has|have|had|do|does|did|can|could|will|would|should|must|may|might|am|[\w]+n['’]t)\b"
NOT_REPLACED = (
    r"(?!(?:so|just|only|merely|simply|solely|even|yet|quite|very|too|all|always|never|often|also|enough|really|actually|entirely|ready|close|done|easy|hard|clear|simple|possible|likely|true|false|fine|good|bad|better|worse"
    r"|obvious|important|different|not|no|nothing|there|here|what|who|how|why|when|where|because|i|me|he|him|she|her|it|we|us|you|they|them|that|this|these|those|his|their|its|my|your|our"
    r"|in|on|at|of|to|for|from|with|as|by|toward|towards|into|over|under|through|against|upon|within|without)\b)"
)
NOT_CORRECTED = (
    r"(?!(?:also|that|this|these|those|they|it|he|she|we|you|i|his|her|their|its|my|your|our|there|then|still|now|is|was|are|were|has|had|have|will|would|could|should|may|might|must|can|to|as|if|when|because"
    r"|not|no|never|nor|neither|every\w*|nobody|none|some|somebody|someone|anyone|anybody|anything|nothing|many|most|few)\b)"
)
ONE_ITEM = r"one[ \t]+(?=[a-z])[\w'’-]+(?:[ \t]+(?!and\b|or\b)(?=[a-z])[\w'’-]+)?"
ITEM = r"[ \t]+(?-i:(?=[a-z]))[\w'’-]+(?:[ \t]+(?!and\b|or\b)(?-i:(?=[a-z]))[\w'’-]+)?"
COMMA_AND = rf",{GAP}(?:and{GAP})?"
FROM_TO = r"from\s+(?=[a-z])(?:[\w'-]+\s+){1,3}to\s+(?=[a-z])(?:[\w'-]+\s+){0,2}[\w'-]+"
NO_ITEM = r"no[ \t]+[\w'-]+(?:[ \t]+[\w'-]+)?[ \t]*[.;!]"
NOT_A_UNIT = r"(?!of\b|by\b|per\b|(?:hour|minute|second|day|week|month|year|dollar|cent|mile|foot|inch|pound|kilo|metre|meter)s?\b)(?-i:(?=[a-z]))[\w'’-]+"
NEGATIVE = r"(?:Nothing|Nobody|No[ \t]+one|None)"
CLAUSE_END = r"(?:[.!?]|,[ \t]+(?:and|but|or|so|yet|nor)\b|[,;:])"
SHORT = r"""[A-Za-z][^.!?\n"“”0-9]{3,29}(?<![^A-Za-z'’][A-Za-z])\."""
TEASED = r"\s+(?:(?:will|won'?t|don'?t|doesn'?t|actually|ever|really|never|rarely|wants?\s+to)\s+){0,2}(?:tells?|gets?|talks?|says?|admits?|mentions?|warns?|teach(?:es)?|explains?|notices?|realizes?|understands?|hears?)\b"
TEASER = r"(?:what|the\s+(?:part|thing|bit|secret))\s+"
TEASERS = r"nobody|no[-\s]?one|most\s+\w+(?:\s+\w+)?|few\s+people|hardly\s+anyone|almost\s+(?:nobody|no[-\s]?one)|people"
ECHO_GAP = r"(?:[ \t ]{1,2}|\r?\n(?![ \t ]*\r?\n)[ \t ]{0,4})"
LIST_LINE = r"(?!\r?\n[ \t]*(?:[-*+•|]|\d+[.)])[ \t])"


#: What goes before a note whose prefix is SIXTY.
STOPPED = r"[.!?][ \t]{1,2}"
#: The end of the first of three short sentences, and the other two.
SHORT_ENDS = r"\.(?:(?:[ \t]{1,2}|\r?\n[ \t]{0,4})[A-Za-z][^.!?\n\"“”0-9]{3,29}\.){2}"


def _rule(id: str, category: str, severity: str, confidence: str, pattern: str, message: str, **more) -> dict:
    if more.get("prefix") == SIXTY:
        more |= {"idle": OTHER_SENTENCE, "hint": f"{STOPPED}(?:{pattern})"}
    return {"id": id, "category": category, "severity": severity, "confidence": confidence, "pattern": pattern, "message": message, **more}


GUARDED: tuple[dict, ...] = (
    _rule("no-x-no-y-frag", "cadence", "warning", "medium", rf"{NO_ITEM}(?:(?:[ \t]{{1,2}}|\r?\n(?!\s*\n)[ \t]*)(?:and[ \t]+)?{NO_ITEM})++", "A chain of %{count} negated fragments.", count_group=r"(?i)\bno\b", prefix=r"(?:^|(?<=[.;!?])[ \t]{1,2})"),
    _rule("thats-the-whole", "closer", "warning", "high", rf"\b(?:that|this)(?:['’]s|{NB}is){NB}the{NB}whole{NB}(?:{CLOSERS})\b", "A closer that claims the whole."),
    _rule("is-the-whole-x", "closer", "warning", "medium", rf"(?<![\w'’-])(?!(?:that|this){NB}is{NB}the{NB}whole{NB}(?:{CLOSERS})(?![\w'’-]))(?!(?:what|which|who|where|when|how)(?![\w'’-]))[\w'’-]+{NB}is{NB}the{NB}(?:(?:whole|real|actual){NB}(?:{WHOLE_NOUNS})|entire{NB}(?!(?:point|game|thing|deal|story)(?![\w'’-]))(?:{WHOLE_NOUNS}))(?![\w'’-])", "One thing is ranked as the whole of another."),
    _rule("bare-equative", "closer", "warning", "medium", rf"The{GAP}(?:{EQUATED}){GAP}(?:here{GAP})?is(?:n['’]t|{GAP}not)?{GAP}the{GAP}(?!(?:one|same|only|first|last|best|worst|next|other|latter|former)\b)(?=[a-z])", "A definition by equation.", ignore_case=False, prefix=SENTENCE + BULLET),
    _rule("epistrophe", "cadence", "info", "low", rf"\b((?!the\b|a\b|an\b)[\w'’-]+){INDENT}([\w'’-]{{4,}}),(?:[ \t]{{1,2}}|\r?\n(?!\s*\n)[ \t]{{0,4}})(?:(?:and|but){INDENT})?(?=\w)(?:[^.,;:!?\n\s]|(?<![ \t])[ \t]{{1,2}}(?![ \t])|\r?\n(?!\s*\n)[ \t]{{0,4}}){{5,60}}?\b\3{INDENT}\4[.!?]", "Two clauses end on the same words."),
    _rule("phrase-echo", "cadence", "info", "low", rf"(?<![{LETTER}'’-])(?=(?:[\w'’-]+{ECHO_GAP}){{0,2}}[a-z]{{6,}}(?![\w'’-]))([a-z][\w'’-]{{3,}}){ECHO_GAP}([a-z][\w'’-]{{3,}}){ECHO_GAP}([a-z][\w'’-]{{3,}})\b(?=(?>(?:{LIST_LINE}[^{LETTER}]){{1,80}}[{LETTER}]+){{0,400}}?(?:{LIST_LINE}[^{LETTER}\"“‘'`*|-]){{1,80}}\3{ECHO_GAP}\4{ECHO_GAP}\5\b)", "Three words come back within some hundred words.", ignore_case=False, echo=3),
    _rule("from-x-to-y-chain", "cadence", "warning", "high", rf"\b{FROM_TO}(?:,\s+(?:and\s+)?{FROM_TO}(?=[^\w\s'-]|\s+(?:and|or|but|in|on|at|by|with|within|over|across|as|when|while|which|that|so|because|what|how|why|who)\b|\s*\z))++", "A chain of %{count} ranges.", count_group=r"(?i)(?:\A|,\s+(?:and\s+)?)from\b", skip=(r"(?i)\bto\s+(?:[\w'-]+\s+){0,2}([\w'-]+),\s+(?:and\s+)?from\s+(?:[\w'-]+\s+){0,2}\1(?![\w'-])", r"(?i)\bfrom\s+(?:the\s+)?((?:[\w'-]+\s+){0,2}[\w'-]+)\s+to\s+(?:the\s+)?\1(?=,|\s*\z)")),
    _rule("one-x-one-y", "cadence", "warning", "high", rf"{ONE_ITEM}{COMMA_AND}{ONE_ITEM}(?:(?:{COMMA_AND}|{GAP}and{GAP}){ONE_ITEM}(?=[^\w\s'’-]|\s+(?:and|or|but|in|on|at|by|with|for|to|of|from|per|each|that|which|who|when|where|so|because|is|are|was|were)\b|\s*\z))++", "A chain of %{count} single items.", count_group=r"(?i)(?:\A|,\s+(?:and\s+)?|\s+and\s+)one\b", skip=(r"(?i)(?:\bone\s+for\b[\s\S]*?){3}",), prefix=r"(?:^|(?<=[.!?:;—–])[ \t]{1,2})"),
    _rule("the-x-is-the-x", "cadence", "error", "high", rf"\bthe\s+({HEADS})\b(?:[^.!?;:,\n]|\r?\n(?!\s*\n)){{1,50}}?\bis(?:n['’]t|\s+not)?\s+the\s+\3(?=[,.;:!?]|\s+(?:of|for|with|in|on|to|at|behind|about|that|which|why|here|there|the|a|an|this|these|those|my|our|your|their|its|his|her|it|they|we|you|i|he|she|every|each|most|many|some|any|no|nobody|everyone|people|[a-z]+s)\b)", "A noun is equated with itself."),
    _rule("the-x-is-not-the-x", "cadence", "warning", "medium", rf"\bthe{NB}(?!(?:{HEADS}|same)\b)(\p{{IsAlphabetic}}{{2,}})\b(?:[^.!?;:,\n]|\r?\n(?!\s*\n)){{0,50}}?\b(?:is|are|was|were)(?:n['’]t|{NB}not){NB}the{NB}\3\b(?!['’-]|{NB}of\b)", "A noun is split in two and neither half is named."),
    _rule("same-determiner-chain", "cadence", "info", "medium", rf"\b(every|each|your|our|more|less|fewer|same|any|another|zero|new|real|true){ITEM}{COMMA_AND}\3{ITEM}(?:(?:{COMMA_AND}|{GAP}and{GAP})\3{ITEM}(?=[^\w\s'’-]|\s+(?:and|or|but|in|on|at|by|with|for|to|of|from|per|than|that|which|who|when|where|so|because|is|are|was|were|will|would|can|could|should|must|may|might|has|have|had|do|does|did|all|every|each|need|needs|make|makes|bring|brings|matter|matters|today|now|then|here|there)\b|\s*\z))++", "A chain of %{count} items on one determiner.", count_group=r"(?i)(?:\A|,\s+(?:and\s+)?|\s+and\s+)(?:every|each|your|our|more|less|fewer|same|any|another|zero|new|real|true)\b"),
    _rule("dont-verb-it", "false-correction", "warning", "high", r"\b(?:don't|do\s+not)\s+(\w+)\s+it\b[^.!?]*[.!?]\s*\3\s+it\b", "An order is refused to be given again."),
    _rule("real-x-real-y", "cadence", "info", "medium", rf"(?<!-)\breal(?!-)[ \t]+(?!(?:{REAL_NEXT})\b)(?>([a-z][\w'’-]*))\b(?:(?!\breal\b)[^.!?\n]|(?!{BREAK})\r?\n){{1,200}}?(?<!-)\breal(?!-)[ \t]+(?!(?:{REAL_NEXT})\b)(?!\3\b)(?>[a-z][\w'’-]*)\b", "The same intensifier twice."),
    _rule("exact-exactly", "self-rating", "info", "medium", r"\b(?:(?:that|this|it|these|those|which)(?:'s|’s|\s+(?:is|was|are|were))\s+(?:the\s+)?exact(?:ly)?\b(?!\s*(?:(?:the\s+)?(?:same|opposite|science|change|replica|cop(?:y|ies)|location|coordinates|way)\b|[$\d]|noon\b|midnight\b|o'?\s*clock\b|(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|dozen|twenty|thirty|fifty|hundred)\b|(?:the\s+|a\s+|an\s+)?(?:[\w-]+\s+){0,2}(?:diameter|radius|size|dimensions?|length|width|height|depth|thickness|weight|mass|volume|angle|pitch|temperature|pressure|speed|altitude|position|distance|clearance|tolerance)\b))|exactly\s+(?:right|wrong|backwards|so)\b|exactly\s+the\s+(?:point|problem|issue|reason|kind|sort|type|thing|question|shape|word)\b|the\s+exact\s+(?:point|problem|issue|reason|thing|question|shape)\b|know(?:s|n)?\s+exactly\s+(?:why|what|how|who)\b|knew\s+exactly\s+(?:why|what|how|who)\b)", "Exactness is claimed where nothing is measured."),
    _rule("load-bearing", "borrowed-metaphor", "warning", "high", rf"\b(?:{BUILDING}\s+(?:is|are|was|were)\s+)?load[-\s]?bearing\b(?!\s+{BUILDING}\b)", "A builder's word for importance.", skip=(rf"(?i)\A{BUILDING}\s+(?:is|are|was|were)\s+load",)),
    _rule("intersection-of", "borrowed-metaphor", "warning", "high", r"\b[Tt]he\s+intersection\s+of\b(?!\s+(?:[\w-]+\s+){0,2}(?i:sets?|lines?|curves?|planes?|circles?|spheres?|axes|rays?|segments?|arcs?|orbits?|streets?|avenues?|roads?|highways?|routes?|tracks?|corridors?|paths?|boulevards?|lanes?|arrays?|lists?|ranges?|collections?|keys?|vectors?|matrices|polygons?|rectangles?|intervals?|data|datasets?|runways?|taxiways?|taxilanes?|aprons?|rows?|columns?|cells?)\b)(?!\s+[A-Z]{1,3}\s+\d)(?=\s+(?:[a-z]|[A-Z]{2,}\b(?!-\d)))", "A place on a map for a mix of subjects.", ignore_case=False),
    _rule("impact-verb", "borrowed-metaphor", "warning", "high", r"\b(?:(?:will|would|can|could|may|might|shall|should|must|does|do|did|doesn't|don't|didn't|won't|helps?|helped)\s+(?:(?:it|this|that|they|we|you)\s+)?impacts?|to\s+impacts?(?=\s+(?!and\b|or\b|but\b|in\b|on\b|at\b|of\b|for\b|from\b|with\b|during\b|after\b|before\b|than\b)\w)|(?:it|this|that|which|he|she)\s+impacts|(?:they|we|you)\s+impact|(?:" + IMPACTED + r"\s+(?:is|are|was|were)\s+)?impact(?:ed|ing))\b(?!-)(?!\s+(?:be|been|is|are|was|were|of|on|has|have|had)\b)(?!\s+(?:tooth|teeth|molars?|wisdom|canines?|bowels?|colon|stool|feces|fecal|fractures?|soils?|snow|ice|sediment|gravel|earwax|cerumen)\b)(?!\s+(?:the\s+|a\s+|an\s+)?(?:[\w-]+\s+)?(?:terrain|ground|seabed|seawall|treetops|trees?|grove|thicket|hillside|embankment|berm|escarpment|ridgeline|cliff|runway|taxiway|apron|tarmac|guardrail|fuselage|nacelle|airframe|empennage|rotor|windshield|bulkhead|revetment|abutment|wing|wingtip|stabilizer|landing\s+gear)\b)" + IMPACT_COMPOUND, "Impact is a verb that hides what changed.", skip=(rf"(?i)\A{IMPACTED}\s+(?:is|are|was|were)\s+impacted",)),
    _rule("impact-noun-vague", "puffery", "error", "high", r"\b(?:statistically\s+)?(?:(?:significant|real|meaningful|lasting|massive|huge|profound|big|major|tremendous|enormous|outsized|considerable|substantial|genuine|tangible|immense|incredible|remarkable)\s+|(?:mak(?:e|es|ing)|made|hav(?:e|es|ing)|has|had)\s+(?:a|an|real|some)\s+)impacts?\b(?!-)" + IMPACT_COMPOUND, "An effect is graded and not stated.", skip=(r"(?i)\Astatistically\s",)),
    _rule("cataphoric-teaser", "self-rating", "warning", "high", rf"(?:\A|[.!?]\s+|\n\s*\n|:\s+)\s*(?:(?:\w+,?\s+)?(?:here'?s|here\s+is|this\s+is)\s+{TEASER}(?:{TEASERS}|they){TEASED}|(?-i:(?=[A-Z])){TEASER}(?:{TEASERS}){TEASED}[^.!?\n:]{{0,60}}?(?:\s+is\b|:))", "A hidden insight is promised."),
    _rule("notice-what", "reader-address", "info", "medium", OPENING + r"notice\s+what\b(?![^.!?\n]{0,40}\b(?:did|does|just\s+did)\s+there\b)", "The reader is told to look."),
    _rule("actually-not-x", "false-correction", "warning", "high", rf"\bactually\b[^.;:!?,\n]{{0,120}}(?<=[{LETTER}]),[ \t]*not\b", "A correction of what nobody said.", prefix=r"(?:\A|(?<=[.;:!?\n]))[^.;:!?,\n]{0,200}"),
    _rule("and-nothing-else", "closer", "warning", "high", rf",{WRAP}(?:(?:and{WRAP})?nothing{WRAP}(?:else|more|further)|and{WRAP}no{WRAP}more)[ \t]*(?=[\"'”’)\]]*[.!])", "A tail that only excludes the rest."),
    _rule("nothing-else-frag", "closer", "warning", "high", r"(?:And[ \t]+nothing|Nothing)[ \t]+(?:else|more|further)[ \t]*[.!]", "A fragment that only excludes the rest.", ignore_case=False, prefix=r"(?<=[.!?])(?:[ \t]{1,2}|\r?\n(?!\s*\n)[ \t]*)"),
    _rule("not-just-x-but-y", "false-correction", "warning", "high", COPULA + r"\s+not\s+(?:just|only|merely|simply|solely)\b(?:(?!\bbut\b)(?:[^.!?\n]|\n(?!\s*\n)))*+\bbut\b(?:\s+also\b)?|\bnot\s+because\b(?:[^.!?;\n]|\n(?!\s*\n)){1,60}?\bbut\s+because\b", "An escalation by formula."),
    _rule("not-x-but-y", "false-correction", "warning", "medium", COPULA + r"\s+not\s+(?!(?:so|just|only|merely|simply|solely|even|yet|quite|very|too|all|always|enough)\b)" + ARTICLE + rf"[\w'’-]+,?{GAP}but{GAP}(?:rather{GAP})?" + NOT_CORRECTED + ARTICLE + r"[\w'’-]+", "A correction by formula."),
    _rule("isnt-x-its-y", "false-correction", "warning", "medium", r"(?:\b(?:is|are|was|were)\s+not|\b(?:is|are|was|were)n['’]t|\b(?:it|that|this|there)['’]s\s+not|\b(?:they|these|those|we|you)['’]re\s+not)" + rf"{GAP}(?>{ARTICLE}){NOT_REPLACED}[\w'’-]+[^.!?;\n]{{0,40}}?(?:[.!?;]|[ \t]*[—–]|,){GAP}(?:it|this|that|these|those|they)(?:['’]s|['’]re|\s+is|\s+are|\s+was|\s+were){GAP}(?>{ARTICLE}){NOT_REPLACED}[\w'’-]+", "One description is refused to give another."),
    _rule("not-by-x-but-by-y", "false-correction", "warning", "medium", rf"\bnot{GAP}(by|for|from|with|about|in|on|at|to|of|through|because{GAP}of|out{GAP}of){GAP}(?:[\w'’-]+{GAP}){{0,5}}[\w'’-]+,?{GAP}but{GAP}(?:rather{GAP})?\3{GAP}(?!(?:that|this|it|him|her|them|me|us|you|which|whom|what)\b){ARTICLE}[\w'’-]+", "A correction on a repeated preposition."),
    _rule("everyone-nobody", "cadence", "warning", "high", rf"(?:(?:everyone|everybody)[ \t]+[^,.;:!?\n]{{2,80}},[ \t]{{1,2}}(?:nobody|no[ \t]+one|none(?![ \t]+(?:of|more|less|so)\b|[ \t]+\w+er\b)|one[ \t]+{NOT_A_UNIT})|(?:nobody|no[ \t]+one)[ \t]+[^,.;:!?\n]{{2,80}},[ \t]{{1,2}}(?:everyone|everybody|one[ \t]+{NOT_A_UNIT}))[ \t]+[^,.;:!?\n]{{2,80}}[.;!?]", "All against none in one sentence.", prefix=r"(?:^|(?<=[.!?:;])[ \t]{1,2})"),
    _rule("punch-sentence", "cadence", "info", "medium", r"(?<![A-Z]\.[ \t]|[A-Z][a-z]\.[ \t]|[A-Z][a-z]{2}\.[ \t]|[A-Z][a-z]{3}\.[ \t]|[ \t][a-z]\.[ \t]|[A-Z]\.[ \t]{2}|[A-Z][a-z]\.[ \t]{2}|[A-Z][a-z]{2}\.[ \t]{2}|[A-Z][a-z]{3}\.[ \t]{2}|[ \t][a-z]\.[ \t]{2})(?:(?:Not|No|Never|Nothing|None)(?:(?:[ \t]|\r?\n(?!\s*\n)[ \t]*)[a-z][A-Za-z'’-]*){0,2}|[A-Z][A-Za-z'’-]{4,})\.(?=[ \t]{1,2}[A-Z](?:[^.!?\n]|\r?\n(?!\s*\n)){40})", "A beat without a verb between two long sentences.", ignore_case=False, prefix=SIXTY),
    _rule("np-fragment-and", "cadence", "warning", "medium", rf"(?:A|An|One){GAP}(?:(?!{AUXILIARY})[\w'’-]+{GAP}){{0,2}}(?!{AUXILIARY})[\w'’-]+,?{GAP}and{GAP}(?:a|an|one){GAP}(?:(?!{AUXILIARY})[\w'’-]+(?:{GAP}|(?=\.))){{1,3}}\.(?=\s|\z)", "Two nouns stand for a sentence.", ignore_case=False, prefix=SENTENCE + BULLET),
    _rule("negative-subject", "cadence", "warning", "medium", rf"(?:[*_]{{1,2}})?(?:{NEGATIVE}(?>(?:[ \t]+(?!and\b)[\w'’-]+){{1,8}})[ \t]+and[ \t]+{NEGATIVE}(?>(?:[ \t]+[\w'’-]+){{1,8}}){CLAUSE_END}|(?<=\A|[.;:!?\n][ \t]{{0,40}}|[.;:!?\n][ \t]{{0,40}}[*_]{{1,2}}|\A[*_]{{1,2}}){NEGATIVE}(?>(?:[ \t]+(?!that\b)[\w'’-]+){{1,3}})[ \t]+that[ \t]+(?:(?:does|do|did|has|have|had|is|are|was|were)[ \t]+not|(?:doesn|don|didn|hasn|haven|hadn|isn|aren|wasn|weren)['’]t)(?>(?:[ \t]+[\w'’-]+){{1,10}}){CLAUSE_END})", "A subject that names nobody.", prefix=r"(?:\A|(?<=[.;:!?\n])[ \t]*|\b(?:and|but|or|so|yet|nor)\b[ \t]+)"),
    _rule("quip-question", "reader-address", "info", "medium", rf"(?:No|New|Still|Not|Already|Ready|Curious|Unsure|Stuck|Tired|Confused|Worried){GAP}(?:(?!{QUIP_AUXILIARY})[\w'’-]+{GAP}){{0,3}}(?!{QUIP_AUXILIARY})[\w'’-]+[ \t]*\?", "A question without a verb.", ignore_case=False, prefix=SENTENCE),
    _rule("mic-drop-closer", "cadence", "info", "medium", rf"(?:Nothing|Most|None|Everything|Everyone|Nobody|Then|Neither|Both)(?:,?{GAP}[\w'’-]+){{1,7}}[.!?]{PARAGRAPH_END}", "A short sweeping closer after a long sentence.", ignore_case=False, prefix=SIXTY),
    _rule("bare-auxiliary-closer", "cadence", "info", "medium", rf"(?![^.!?\n]*\b(?:what|that|which|who|why|how)\b)[A-Z][\w'’-]*(?:[ \t]+[\w'’-]+){{0,2}}[ \t]+(?:(?:did|does|do|was|were|is|are|had|has|could|would|should|might|must)(?:n['’]t)?|can(?:['’]t)?|will|won['’]t)\.{PARAGRAPH_END}", "A closer that ends on an auxiliary.", ignore_case=False, prefix=SIXTY),
    _rule("short-run", "cadence", "info", "medium", rf"(?:{SHORT}(?:[ \t]{{1,2}}|\r?\n(?!\s*\n)[ \t]{{0,4}})(?![-*+•][ \t]|o[ \t]+[A-Z]|\d+[.)][ \t]|[A-Za-z][.)][ \t]+[A-Z])){{2}}{SHORT}(?=\s|\z)", "Three short sentences in a row.", ignore_case=False, prefix=r"(?:\A|(?<=\n\n)|(?<=[.!?])[ \t]{0,2}\r?\n|(?<=[.!?])[ \t]{1,2})[ \t]{0,4}(?:[-*+•][ \t]+|o[ \t]+(?=[A-Z])|\d+[.)][ \t]+|[A-Za-z][.)][ \t]+(?=[A-Z]))?", skip=(r"\b(?:Corp|Prof|Dept|Sept|Univ|Assn|approx|misc|cont|Ave|Blvd|Fig|Est|Inc|Ltd|vol|etc|Mrs|Mr|Ms|Dr|St|Jr|Sr|No)\.", r"\A\S+\.[ \t\r\n]+\S+\.[ \t\r\n]+\S+\.\z", r"\A[a-z][^.!?]*\.\s+[a-z][^.!?]*\.\s+[a-z][^.!?]*\.\z"), hint=SHORT_ENDS),
    _rule("trailing-significance-participle", "puffery", "error", "high", r"(?:(?<!\w)|\G)\w++(?<!ing),[ \t]+(?:further[ \t]+|thereby[ \t]+|thus[ \t]+|ultimately[ \t]+)?(?:highlighting|showcasing|reinforcing|shaping|enhancing|cementing|solidifying|embodying|fostering|facilitating|signall?ing(?![ \t]+to\b))(?![ \t]*(?:,|and\b|or\b))[ \t]+\S", "A tail that claims significance."),
    _rule("trailing-restatement", "closer", "warning", "low", rf",{NB}(?:which{NB}means\b|which{NB}is{NB}to{NB}say\b|meaning{NB}(?:that|the|a|an|this|these|those|it|he|she|we|you|they|there|nothing|every|each|any|all|most|some|your|our|their|its)\b|making{NB}(?:it|them|us|you|the(?:{NB}[\w'’-]+){{1,2}}){NB}(?:[a-z]+er|(?:im)?possible|(?:more|less)(?:{NB}[a-z]+)?)(?={NB}(?:to|for|than)\b|[ \t]*[.,;:!?)]|[ \t]*\r?\n|[ \t]*\z)|allowing{NB}(?:it|them|us|you){NB}to\b|giving{NB}(?:them|us|you){NB}(?:more|less|time|room)\b|leaving{NB}(?:them|us|you){NB}with(?:out)?\b)", "A tail that says the sentence again."),
)
