"""Fixed word and character lists."""

from __future__ import annotations

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# English stop words, matched case-sensitively. Contractions are
# left out because punctuation is deleted before words are compared.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()

# Words whose full stop does not end a sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof st sr jr vs gen sen rep gov capt lt col sgt rev hon "
    "fig inc ltd co corp dept est approx"
).split()

# Characters that rule a line out of a name or word list.
NAME_FORBIDDEN = r'[<>:"/\\|?*]'
