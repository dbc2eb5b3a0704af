"""Word lists, patterns and limits. All are defaults: operators take them as parameters."""

# Words, patterns and numbers that results depend on.

SEARCH_STOPWORDS = tuple(
    """a an and are as at be by for from has have in is it its of on or that the
    to was were will with this these those we our us you your they their""".split()
)

JUDGE_STOPWORDS = tuple(
    """a an and are as at be by for from has have in is it its of on or that the
    to was were will with this these those we our they their he she them can could
    should would than then there here when where which who whom what how why
    do does did done been being also into over under between about such only
    very just now both each any all more most other some""".split()
)

BM25_K1, BM25_B = 1.5, 0.75
FUSION_K = 60
PHRASE_BONUS = 0.5
CANDIDATE_FACTOR, CANDIDATE_CAP = 4, 200
SUPPORT_THRESHOLD = 0.3
CONFLICT_GAP = 0.05
CLAIM_LENGTHS = (60, 600)
CLAIM_OVERLAP = 0.25
CLAIM_PAIRS = 24
COVERAGE_FLOOR = 0.4
TOP_GAPS = 12
DATASET_WINDOW = 240
RESULT_TEXT_CHARS = 18000
ENTITY_TEXT_CHARS = 12000
GRAPH_TEXT_CHARS = 24000

METRIC_ALIASES = {
    "f1": "f1", "f-1": "f1", "f1 score": "f1", "f1-score": "f1",
    "em": "exact match", "exact-match": "exact match", "acc": "accuracy",
    "top-1": "top-1 accuracy", "top-5": "top-5 accuracy", "rouge-l": "rouge-l",
    "bleu-4": "bleu", "ndcg@10": "ndcg", "auroc": "roc-auc",
}
LOWER_IS_BETTER = ("perplexity", "wer", "cer", "loss", "latency", "error rate")

CLAIM_MARKERS = (
    "we find", "we show", "we observe", "results show", "our results",
    "outperforms", "improves", "degrades", "significantly", "demonstrates",
    "suggests that", "indicates that", "conclude", "however", "in contrast",
)
FUTURE_WORK_MARKERS = (
    "future work", "future research", "we leave", "left for future",
    "remains an open", "open question", "an interesting direction",
    "further work", "we plan to", "has yet to be", "remains unexplored",
)
REFUSAL_MARKERS = (
    "do not contain", "does not contain", "no information", "not enough information",
    "cannot answer", "can't answer", "not covered", "no relevant", "unable to answer",
    "the sources do not", "insufficient",
)

INJECTION_PATTERNS = (
    r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?",
    r"disregard\s+(?:all\s+)?(?:previous|prior|above)",
    r"you\s+are\s+now\s+(?:a|an)\s+",
    r"(?:reveal|print|output|repeat)\s+(?:your\s+)?system\s+prompt",
    r"<\s*/?\s*(?:system|assistant)\s*>",
    r"\bBEGIN\s+SYSTEM\b",
)
#: Zero-width and bidirectional control characters.
INVISIBLE = "[​-‏‪-‮⁠-⁤﻿]"

HEADING_WORDS = (
    "ABSTRACT", "INTRODUCTION", "RELATED WORK", "BACKGROUND", "METHODS", "METHOD",
    "METHODOLOGY", "APPROACH", "EXPERIMENTS", "EXPERIMENT", "EVALUATION", "RESULTS", "DISCUSSION",
    "CONCLUSIONS", "CONCLUSION", "LIMITATIONS", "FUTURE WORK", "ACKNOWLEDGMENTS",
)

ENTITY_TERMS = {
    "Dataset": (
        "imagenet", "mnist", "cifar-10", "cifar-100", "coco", "squad", "squad 2.0",
        "glue", "superglue", "wikitext", "c4", "the pile", "common crawl", "ms marco",
        "natural questions", "hotpotqa", "triviaqa", "beir", "wikisql", "spider",
        "librispeech", "conll-2003", "snli", "multinli", "openwebtext", "arxiv",
    ),
    "Model": (
        "bert", "roberta", "albert", "distilbert", "electra", "gpt-2", "gpt-3", "gpt-4",
        "t5", "flan-t5", "bart", "llama", "llama 2", "llama 3", "mistral", "mixtral",
        "claude", "gemini", "palm", "vit", "resnet", "efficientnet", "clip", "whisper",
        "transformer", "lstm", "gru", "colbert", "dpr", "splade", "e5", "bge",
    ),
    "Metric": (
        "accuracy", "f1", "f1 score", "precision", "recall", "bleu", "rouge", "rouge-l",
        "meteor", "perplexity", "map", "mrr", "ndcg", "auc", "roc-auc", "exact match",
        "wer", "cer", "iou", "map@k", "recall@k", "hit rate",
    ),
    "Task": (
        "question answering", "text classification", "named entity recognition",
        "machine translation", "summarization", "sentiment analysis", "image classification",
        "object detection", "semantic segmentation", "speech recognition",
        "information retrieval", "language modeling", "code generation",
        "reading comprehension", "entity linking", "relation extraction",
    ),
    "Method": (
        "self-attention", "multi-head attention", "contrastive learning", "fine-tuning",
        "prompt tuning", "lora", "qlora", "knowledge distillation", "quantization",
        "reinforcement learning from human feedback", "rlhf", "chain-of-thought",
        "retrieval-augmented generation", "beam search", "dropout", "batch normalization",
        "layer normalization", "gradient checkpointing", "mixture of experts",
    ),
    "Benchmark": (
        "glue", "superglue", "mmlu", "big-bench", "helm", "beir", "hellaswag",
        "arc", "truthfulqa", "gsm8k", "humaneval", "mbpp", "lambada",
    ),
}
RELATION_OF_LABEL = {"Dataset": "USES_DATASET", "Model": "PROPOSES", "Metric": "REPORTS", "Task": "ADDRESSES", "Method": "USES_METHOD", "Benchmark": "EVALUATES_ON"}

#: relation -> (label it starts at, label it ends at)
LEGAL_EDGES = {
    "AUTHORED_BY": ("Paper", "Author"),
    "AFFILIATED_WITH": ("Author", "Institution"),
    "CITES": ("Paper", "Paper"),
    "EVALUATES_ON": ("Paper", "Benchmark"),
    "USES_DATASET": ("Paper", "Dataset"),
    "PROPOSES": ("Paper", "Model"),
    "USES_METHOD": ("Paper", "Method"),
    "REPORTS": ("Paper", "Metric"),
    "ADDRESSES": ("Paper", "Task"),
    "PUBLISHED_IN": ("Paper", "Venue"),
    "COMPARES_TO": ("Model", "Model"),
}

RESULT_PATTERN = (
    r"(?i)(accuracy|f1(?:[ -]score)?|exact match|em|bleu|rouge(?:-l)?|meteor|"
    r"perplexity|ndcg(?:@\d+)?|mrr|map(?:@\d+)?|recall(?:@\d+)?|precision|wer|cer|auc|"
    r"roc-auc|top-\d)\s*(?:score\s*)?(?:of|is|was|reaches|reaching|achieves|achieving|=|:)?"
    r"\s*(\d{1,3}(?:\.\d+)?)\s*(%)?"
)
DOI_PATTERN = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)"
ARXIV_PATTERN = r"(?i)\barXiv[:\s]\s*((?:\d{4}\.\d{4,5}(?:v\d+)?)|(?:[a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?))"
YEAR_PATTERN = r"\b(1[89]\d{2}|20[0-4]\d)\b"
JUNK_TITLE = r"(?i)^(untitled|microsoft word|document\d*|paper|manuscript|\d+|.*\.(dvi|tex|doc|docx|pdf|indd))$"
#: Headings: numbered, Roman, and known words; bibliography heads, what ends a bibliography, and how an entry starts.
NUMBERED_HEADING = r"^[ \t]*(\d{1,2}(?:\.\d{1,2}){0,2})\.?[ \t]+([A-Z].{2,80})[ \t]*$"
ROMAN_HEADING = r"^[ \t]*[IVXLC]{1,5}\.[ \t]+([A-Z].{2,80})[ \t]*$"
REFERENCES_PATTERN = r"(?s)(?:.*)(?:^|\n)[ \t]*(?:(?:[IVXLC]+|\d+)[.)]?[ \t]*)?(?:REFERENCES|References|REFERENCE|Bibliography|BIBLIOGRAPHY|Works Cited)[ \t]*(?:\n|$)(.*)"
AFTERWARDS_PATTERN = r"(?:^|\n)\s*(?:(?:[IVXLC]+|\d+|[A-Z])[.)]?\s*)?(?:APPENDIX|Appendix|APPENDICES|Supplementary|SUPPLEMENTARY)\b"
ENTRY_PATTERN = r"(?m)^\s*(?:\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}\.)\s+"
INITIAL_PATTERN = r"\b[A-Z]\."
ET_AL_PATTERN = r"(?i)\bet al\.?"
VENUE_PATTERN = r"^(In|Proceedings|Proc\.|Journal|Trans\.|Advances|IEEE|ACM|Vol\.?|pp\.?)\b"
CAPTION_PATTERN = r"^\s*(?:Table|TABLE|Figure|FIGURE|Fig\.?|FIG\.?)\s*(\d+|[IVXLC]+)\s*[.:—-]?\s*(.*)$"
#: A figure smaller than this (in points squared) is a rule, a logo or a separator.
MIN_FIGURE_AREA = 5000.0
# End of fixed values.
