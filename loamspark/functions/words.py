"""Word lists that results depend on."""

from __future__ import annotations

# Words that mark a text as English or Italian where they stand in lower case.
MARKERS = {
    "en": """the and of to in that is was for with his her their they this from has have been but not who which after before still about into over than when
while because nobody anyone him she it at on now""".split(),
    "it": """il lo la le gli un una uno di del della dei delle che per con non sono era come anche nel nella alla allo suo sua loro questo questa quando perche
perché ancora dopo prima nessuno più piu sulla sul ora ha dalla dal chiede""".split(),
}

# Function words, which carry no content.
FUNCTION_WORDS = {
    "en": """a about above after again against all am an and any are aren't as at be because
been before being below between both but by can cannot can't could couldn't did didn't do
does doesn't doing don't down during each few for from further had hadn't has hasn't have
haven't having he he'd he'll he's her here here's hers herself him himself his how how's i
i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my
myself no nor not now of off on once only or other ought our ours ourselves out over own same
shan't she she'd she'll she's should shouldn't so some such than that that's the their
theirs them themselves then there there's these they they'd they'll they're they've this
those through to too under until up very was wasn't we we'd we'll we're we've were weren't
what what's when when's where where's which while who whom who's whose why why's with
won't would wouldn't you you'd you'll you're you've your yours yourself yourselves""".split(),
    "it": """a ad affinché agli ai al all alla alle allo anche ancora avere avete abbiamo ha
hai hanno ho c'è che chi ci coi col come con contro cosa cui da dagli dai dal dalla dalle dallo
degli dei del della delle dello di dove e ed è era erano essere fra gli i il in io la le
lei li lo loro ma me mi mia mie miei mio molto ne né negli nei nel nella nelle nello no
noi non nostra nostre nostri nostro o ogni oppure per perché però più poco poi presso qua
quale quali quando quanta quante quanti quanto quel quella quelle quelli quello questa
queste questi questo qui se sei senza si sia siamo siete solo sono sopra sotto sta su sua
sue sui sul sulla sulle sullo suo suoi te ti tra tu tua tue tuo tuoi tutta tutte tutti
tutto un una uno vi voi vostra vostre vostri vostro""".split(),
}

# Words of four letters or more that tell nothing about a scene.
SCENE_STOP = """with from over into onto upon under through beyond against beneath above below near this that these those some many much very more most such
also then than when where while like just""".split()

# Words that are no keywords of an excerpt.
EXCERPT_STOP = "the a an of and or to in on at for with is are was were it its this that as by from".split()
