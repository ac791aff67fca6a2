"""Values that must equal the original corpus scripts for identical results.

FIXED VALUES (copied as plain text because the output depends on them):

- section start marker:           "introduction"
- section conclusion markers:     "conclusions", "conclusion"
- section end markers:            "disclosures", "disclosure", "acknowledgements",
                                  "acknowledgment", "reference", "references", "refs",
                                  "funding", "abbreviations", "additional file"
- dropped paragraph prefixes:     "fig.", "table"
- maximum digit-run share:        0.3 (a paragraph is kept when the share is below it)
- front-matter residue removed:   "==== front"
- useful-content words:           "introduction", "conclusion"; minimum 512 words
- relation prompt:                "find relation between entities - {e1} and {e2} in {text}"
- ignore label id / tag:          -100 / "<ignore>"
- label id of the lone "none" class in multi-label documents: 7
- masking: probability 0.2; of the chosen, 80 % mask id, half of the rest random id
- special vocabulary entries:     [PAD] [UNK] [CLS] [SEP] [MASK] with ids 0..4
"""

INTRO_MARKER = "introduction"
CONCLUSION_MARKERS = ("conclusions", "conclusion")
END_MARKERS = (
    "disclosures",
    "disclosure",
    "acknowledgements",
    "acknowledgment",
    "reference",
    "references",
    "refs",
    "funding",
    "abbreviations",
    "additional file",
)
CAPTION_PREFIXES = ("fig.", "table")
MAX_DIGIT_SHARE = 0.3
FRONT_RESIDUE = "==== front"
USEFUL_WORDS = ("introduction", "conclusion")
MIN_USEFUL_WORDS = 512

RELATION_PROMPT = "find relation between entities - {e1} and {e2} in {text}"

IGNORE_INDEX = -100
IGNORE_TAG = "<ignore>"
NONE_LABEL_ID = 7

MLM_PROBABILITY = 0.2
MASK_REPLACE_SHARE = 0.8
RANDOM_OF_REST_SHARE = 0.5

SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = range(5)
