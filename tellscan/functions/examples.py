"""Sentences of our own for every rule: one with a note, and one with none."""

LONG = "The committee met on Tuesday in the old library and talked until the lamps were lit"
CASES = {
    "no-x-no-y": ("The shop had no bread, no milk, no eggs today.", "The shop had no bread and little milk."),
    "did-not-x-did-not-y": ("He did not call, did not write and did not visit.", "He did not call."),
    "and-what-it-should": ("We knew what it did, and what it should not.", "We knew what it did, and what it should hold."),
    "abstract-lives-in": ("Most of the knowledge lives in the margins.", "My aunt lives in the margins."),
    "sit-with-that": ("Please sit with that until morning.", "Please sit with the others."),
    "hold-onto-that": ("It rained. Hold onto that while we go on.", "It rained. Hold onto the rail."),
    "cleanly": ("The road forks cleanly into two.", "The road forks cleanly today."),
    "clean-count": ("The estate falls into three clean parts.", "The maid brought three clean towels."),
    "cleanest-x": ("It is the cleanest summary of the trial.", "It is the cleanest kitchen in town."),
    "clean-x": ("There is a clean distinction here.", "There is a clean plate here."),
    "you-already-know": ("As you already know, trains run late.", "As they already know, trains run late."),
    "is-the-entire": ("Speed is the entire point of it.", "Speed is the entire charm of it."),
    "the-entire-is": ("The entire game is patience.", "The entire county is flooded."),
    "is-real-and-not": ("The cost is real, but small.", "The cost is real enough."),
    "the-punchline-is": ("The punchline: nobody came.", "The punchline made nobody laugh."),
    "worth-naming": ("Two costs are worth flagging.", "Two costs are worth flagging plainly."),
    "worth-saying-plainly": ("It rained. Worth saying plainly that the roof leaks.", "It rained. Worth buying plainly cut cloth."),
    "not-nothing": ("Forty years at sea was not nothing.", "Forty years at sea was nothing much."),
    "impact-noun-bare": ("They will study the impact of rain.", "They will study the impact of craters."),
    "thats-how-x": ("Water froze. That is how pipes burst.", "Water froze. That is why pipes burst."),
    "announced-takeaway": ("It failed. The lesson for bakers: weigh the flour.", "It failed. The lesson took an hour."),
    "is-is": ("The trouble is is that it rains.", "The trouble is that it rains."),
    "earns-its-place": ("The appendix earns its place.", "The appendix earns its author money."),
    "does-a-lot-of-work": ("That comma does a lot of heavy lifting.", "That crane does a lot of lifting."),
    "failure-mode-here": ("The failure mode here is haste.", "The failure mode is unknown."),
    "thats-the-tension": ("It costs more and breaks less. That's the tension.", "It costs more and breaks less. That's the tension rod."),
    "right-up-until": ("It works right up until it breaks.", "It works right up until noon."),
    "two-things-true": ("Two things can be true.", "Two things can be sold."),
    "notice-what-there": ("He left early. Read that again.", "He left early. Read that page again."),
    "none-of-this-is-to-say": ("None of this is to say it failed.", "None of this is news."),
    "if-im-being-honest": ("The soup was cold, if I am honest.", "The soup was cold, if you ask the cook."),
    "honestly": ("She reported honestly, then left.", "She also honestly, then left."),
    "honest-x": ("This is an honest accounting of the fire.", "This is an honest man of the fire."),
    "most-honest-x": ("The most honest answer came from the cook.", "The most honest baker came from the north."),
    "genuinely": ("A genuinely cold day.", "A genuine coin."),
    "and-thats-fine": ("The cake sank. And that's fine.", "The cake sank. And that's final."),
    "puffery-words": ("A vibrant town on the coast.", "A quiet town on the coast."),
    "stands-serves-as": ("The barn serves as a school.", "The barn serves the school."),
    "vital-role": ("Salt plays a vital role there.", "Salt plays a part there."),
    "underscores-highlights": ("The flood underscores the need for walls.", "The name has two underscores."),
    "rich-tapestry": ("The valley is a rich tapestry.", "The valley has a tapestry."),
    "rule-of-three": ("He packed bread, cheese, and olives.", "He packed bread and olives."),
    "em-dash": ("The door — green — was shut.", "The door was green and shut."),
    "em-dash-overuse": ("The door — green — was shut — again.", "The door was green and shut again."),
    "question-isnt": ("The question isn't whether it rains, it's when.", "The question isn't easy to hear."),
    "less-about-more-about": ("It's less about speed and more about care.", "It's less than a mile away."),
    "vague-attribution": ("Some critics argue it leaks.", "Some critics left early."),
    "no-x-no-y-frag": ("No maps. No guides.", "No maps were sold."),
    "thats-the-whole": ("And that's the whole story.", "That's the whole value chain."),
    "is-the-whole-x": ("Patience is the real trick.", "This is the whole story."),
    "bare-equative": ("The problem is the weather.", "The problem is the same."),
    "epistrophe": ("They built with old timber, and we slept under old timber.", "They built with old timber, and we slept under canvas."),
    "phrase-echo": ("the distant harbour lights shone while sailors sang near the quay, below distant harbour lights again", "the distant harbour lights shone"),
    "from-x-to-y-chain": ("It grew from farms to towns, from boats to big trains and stopped.", "It grew from farms to towns."),
    "one-x-one-y": ("One road, one bridge, one gate with a lock.", "One road and one bridge."),
    "the-x-is-the-x": ("The problem with rain is the problem of drains.", "The problem with rain is the drains."),
    "the-x-is-not-the-x": ("The map is not the map.", "The map is not the land."),
    "same-determiner-chain": ("They counted every sheep, every goat, every cow.", "They counted every sheep and goat."),
    "dont-verb-it": ("Don't paint it. Paint it twice.", "Don't paint it. Sand it."),
    "real-x-real-y": ("It has real teeth and real claws.", "It has real teeth."),
    "exact-exactly": ("He was exactly right.", "That is exactly 12 miles."),
    "load-bearing": ("That clause is load-bearing.", "The wall was load-bearing."),
    "intersection-of": ("She works at the intersection of art and law.", "It is at the intersection of two streets."),
    "impact-verb": ("Rain will impact sales.", "The asteroid will impact the seabed."),
    "impact-noun-vague": ("It had a huge impact.", "It had a huge impact crater."),
    "cataphoric-teaser": ("Here's what nobody tells you.", "Here's what the teacher said."),
    "notice-what": ("Notice what changed.", "They notice what changed."),
    "actually-not-x": ("It was actually a goat, not a sheep.", "It was a goat, not a sheep."),
    "and-nothing-else": ("He ate bread, and nothing else.", "He ate bread and nothing else mattered to him."),
    "nothing-else-frag": ("He ate bread. Nothing else.", "Nothing else was left."),
    "not-just-x-but-y": ("It is not just cold but wet.", "It is not just cold. But wet."),
    "not-x-but-y": ("The cat is not black but grey.", "The cat is not so black but it is grey."),
    "isnt-x-its-y": ("It isn't a bug. It's a feature.", "It isn't ready. It's late."),
    "not-by-x-but-by-y": ("They won not by force but by wit.", "They won by force but not by wit."),
    "everyone-nobody": ("Everyone wants bread, nobody wants to bake.", "Everyone wants bread."),
    "punch-sentence": (f"{LONG}. Never again. The members walked home along the river without saying very much.", f"{LONG}. Never again."),
    "np-fragment-and": ("A hammer and a nail.", "A hammer is here and a nail."),
    "negative-subject": ("Nobody came and nobody called.", "Somebody came and nobody called."),
    "quip-question": ("Still waiting?", "Are you still waiting?"),
    "mic-drop-closer": (f"{LONG}. Nothing was decided.", "Nothing was decided."),
    "bare-auxiliary-closer": (f"{LONG}. The mayor did.", "The mayor did."),
    "short-run": ("The rain fell. We went home. They stayed there.", "The rain fell. We went home."),
    "trailing-significance-participle": ("The town grew, highlighting its harbour.", "The town grew."),
    "trailing-restatement": ("The road closed, which means we walked.", "The road closed."),
}
