"""What to do about a note, for each rule, and why its kind is noted, for each category. Our own wording."""

from __future__ import annotations

RATIONALES = {
    "cadence": "The pattern of the sentence is heard before its content, and a reader who hears it once will wait for it again.",
    "closer": "A last sentence that only rounds off asks the reader to feel an end that the facts have not brought.",
    "puffery": "Praise without a fact behind it could stand in any text, so it says nothing about this one.",
    "reader-address": "Telling readers how to read takes their attention from what there is to read.",
    "self-rating": "A text that grades itself does the reader's work, and mostly where the grade is in doubt.",
    "false-concession": "Something nobody claimed is granted, so that the real claim looks weighed.",
    "false-correction": "A view that nobody holds is set up to be put right, and the claim itself comes late.",
    "borrowed-metaphor": "A trade's word stands where the plain name of the thing would tell more.",
    "punctuation": "A mark that joins anything to anything leaves open how the parts belong together.",
}
SUGGESTIONS = {
    "no-x-no-y": "Say what there is, or name the one lack that matters.",
    "no-x-no-y-frag": "Make one sentence of the lacks, or say what there is.",
    "did-not-x-did-not-y": "Say what was done, or keep the one denial that matters.",
    "thats-the-whole": "Cut the sentence; the one before it has said so.",
    "is-the-whole-x": "Say what the thing does, and leave its rank to the reader.",
    "bare-equative": "Put the fact in place of the equation.",
    "epistrophe": "Vary the second ending, or join the clauses.",
    "phrase-echo": "Reword the repeat, unless it is a term.",
    "from-x-to-y-chain": "List the things that are meant, or give one range.",
    "one-x-one-y": "Count them once, or join them in a plain list.",
    "and-what-it-should": "Spell the second half out, or end before it.",
    "abstract-lives-in": "Say where the thing is found, or who has it.",
    "the-x-is-the-x": "Say what the second thing is in other words.",
    "the-x-is-not-the-x": "Name the two things by different names.",
    "same-determiner-chain": "Use the determiner once, before the list.",
    "dont-verb-it": "Give the order that holds, once.",
    "sit-with-that": "Cut it, and let the fact have its own weight.",
    "hold-onto-that": "Cut it, and come back to the point where it is used.",
    "cleanly": "Say how it divides, or drop the word.",
    "clean-count": "Name the parts.",
    "cleanest-x": "Give the thing itself without its grade.",
    "clean-x": "Say what is divided from what.",
    "you-already-know": "State it, or leave it out if it is known.",
    "is-the-entire": "Say what it is for.",
    "the-entire-is": "Say what happens in it.",
    "is-real-and-not": "Give its size.",
    "real-x-real-y": "Drop both, or say what sets them apart from the others.",
    "the-punchline-is": "Say it without the announcement.",
    "worth-naming": "Name it.",
    "worth-saying-plainly": "Say it plainly, without saying so.",
    "not-nothing": "Say how much it is.",
    "exact-exactly": "Give the measure, or drop the word.",
    "load-bearing": "Say what would fail without it.",
    "intersection-of": "Say which of the subjects it is about.",
    "impact-verb": "Say what it changes, and how.",
    "impact-noun-vague": "Say what changed and by how much.",
    "impact-noun-bare": "Name the effect.",
    "thats-how-x": "Join it to the sentence that tells how.",
    "announced-takeaway": "Give the sentence after the colon.",
    "cataphoric-teaser": "Begin with what is promised.",
    "is-is": "Keep one of the two.",
    "earns-its-place": "Say what it is needed for.",
    "does-a-lot-of-work": "Say what the word is made to mean.",
    "failure-mode-here": "Say what goes wrong.",
    "thats-the-tension": "Say which side gives way.",
    "right-up-until": "Say when it stops.",
    "two-things-true": "State both.",
    "notice-what-there": "Say what was done.",
    "notice-what": "Say what there is to see.",
    "none-of-this-is-to-say": "State the limit itself.",
    "if-im-being-honest": "Drop the opening; the rest stands.",
    "honestly": "Say how it was done.",
    "honest-x": "Give it without the grade.",
    "most-honest-x": "Give it without the grade.",
    "genuinely": "Drop the word.",
    "actually-not-x": "Say what is so; deny only what someone claims.",
    "and-thats-fine": "Cut it, or say why it does no harm.",
    "and-nothing-else": "End at the comma.",
    "nothing-else-frag": "End at the sentence before.",
    "puffery-words": "Say what a visitor would see.",
    "stands-serves-as": "Use is, or say what it does.",
    "vital-role": "Say what it does and what depends on it.",
    "underscores-highlights": "Say what follows from it.",
    "rich-tapestry": "Name the parts.",
    "not-just-x-but-y": "Say the second; the first goes without saying or needs its own sentence.",
    "not-x-but-y": "Say what it is.",
    "isnt-x-its-y": "Say what it is.",
    "not-by-x-but-by-y": "Say by what.",
    "rule-of-three": "Keep the items that carry something.",
    "everyone-nobody": "Say who and how many.",
    "punch-sentence": "Join it to a sentence with a verb.",
    "np-fragment-and": "Give the two nouns a verb.",
    "negative-subject": "Name who or what it is about.",
    "quip-question": "Ask the whole question, or state the answer.",
    "mic-drop-closer": "End on the fact before it.",
    "bare-auxiliary-closer": "Name what was done.",
    "short-run": "Join two of the three.",
    "em-dash": "Use a comma, a colon or a full stop, whichever is meant.",
    "em-dash-overuse": "Keep one, and make sentences of the rest.",
    "question-isnt": "Ask the question that is meant.",
    "less-about-more-about": "Say what it is about.",
    "trailing-significance-participle": "End at the comma, or give the meaning a sentence with evidence.",
    "trailing-restatement": "Keep the clearer of the two halves.",
    "vague-attribution": "Name who says so.",
}
