"""A small benchmark of question answering over documents, as rows for `schemas.BENCHMARK`.

The subjects are everyday troubles of running such a system on one's own data: spelling, age, tables, code, silence,
contradiction, chance, money. Each item has a key of its category and subject.
"""

from __future__ import annotations

NAME, VERSION = "millrace-field-questions", "2025.2"


def item(key: str, category: str, difficulty: str, test_type: str, question: str, concepts: list[str], reasoning: str, correctness: str, grounding: str, tradeoffs: str) -> tuple:
    return key, category, difficulty, test_type, question, concepts, reasoning, (correctness, grounding, tradeoffs)


SUITE = [
    item("tooling-upgrade", "tooling_and_frameworks", "hard", "design", "The team wants to change the model that makes the vectors. Ten million of them are stored. Which steps lead to the new model, and when may the old vectors go?",
         ["re-embedding", "dual write", "embedding version"], "Vectors of two models can't be compared, so new rows are written for both, old rows are embedded again in the background, quality is compared on logged queries, and only then is the old column dropped.",
         "Never mixes vectors of two models in one search.", "Compares both on real queries before the change.", "Counts the double storage and the compute of embedding again."),
    item("tooling-cache", "tooling_and_frameworks", "medium", "practical", "Half of all questions of a help desk repeat within a day. Where can an answer be kept, and what must end its life?",
         ["semantic cache", "cache invalidation", "time to live"], "Answers are kept under the question's meaning and the rights of who asked; a changed source, a new prompt or age removes them.",
         "Ties a kept answer to its sources.", "Keeps users' rights apart.", "Weighs stale answers against cost."),
    item("tooling-trace", "tooling_and_frameworks", "easy", "diagnostic", "A user complains about an answer of last Tuesday. What must have been logged for you to find out which step went wrong?",
         ["tracing", "prompt version", "retrieved passages"], "The question, the passages with their scores, the prompt's version, the model's settings and the answer, all under one identifier.",
         "Lists what each step took and gave.", "Connects the steps by one identifier.", "Mentions privacy and the time that logs are kept."),
    item("tooling-burst", "tooling_and_frameworks", "medium", "design", "The embedding service allows a hundred calls a minute, and a nightly load brings forty thousand documents. How do you plan the load?",
         ["batching", "rate limit", "backoff", "idempotent job"], "Many texts go in one call, calls are spread under the limit, refused ones wait longer each time, and a restart skips what is done already.",
         "Stays below the limit by batches.", "Can be restarted anywhere.", "Weighs large batches against lost work."),
    item("chunk-table", "chunking_and_indexing", "hard", "diagnostic", "Questions about figures in annual reports fail although the reports are indexed. The figures stand in tables of scanned pages. What do you change?",
         ["table extraction", "layout analysis", "row with header"], "Plain text of a table loses which header a number belongs to; rows are stored with their headers and the table's title, and the page image is kept for checking.",
         "Keeps headers with numbers.", "Names a step that recovers the layout.", "Accepts slower loading for the sake of figures."),
    item("chunk-code", "chunking_and_indexing", "medium", "practical", "A search over source code returns the ends of functions without their beginnings. By which borders should code be cut?",
         ["syntax tree", "function", "docstring"], "Code is cut at definitions that a parser finds, a long function keeps its signature in each piece, and comments stay with what they explain.",
         "Cuts along the syntax.", "Keeps a signature with each piece.", "Mentions languages without a parser."),
    item("chunk-boilerplate", "chunking_and_indexing", "easy", "diagnostic", "Every result shows the same legal notice. How did it come to crowd out everything else, and how do you get rid of it?",
         ["boilerplate removal", "deduplication", "template"], "The notice stands in every document, so its copies fill the list; repeated blocks are found by hashes and removed before indexing.",
         "Finds what repeats across documents.", "Removes it before indexing.", "Keeps a copy where the notice itself is asked for."),
    item("chunk-memory", "chunking_and_indexing", "hard", "design", "The vectors no longer fit in memory. Which ways are there to make them smaller, and how do you know what is lost?",
         ["quantization", "dimension truncation", "rescoring"], "Numbers of fewer bits or fewer dimensions shrink them; a first pass on the small ones and a second on the full ones of the best candidates keep most of the quality, which a fixed set of questions shows.",
         "Names at least two ways.", "Measures before and after.", "Weighs memory against a second pass."),
    item("find-spelling", "retrieval", "easy", "practical", "Customers misspell product names in many ways, and nothing is found. What can be done before the index is asked?",
         ["query correction", "character n-grams", "synonym list"], "Known names are compared by characters, near ones are proposed or added to the question, and names that sell are listed with their usual slips.",
         "Works on the question, not on the index.", "Uses the catalogue as a dictionary.", "Avoids changing questions that are right."),
    item("find-age", "retrieval", "medium", "design", "The best match is often a notice that a newer one has replaced. How should age enter the ranking without hiding what never changes?",
         ["recency decay", "document validity", "supersedes link"], "Notices carry when they are valid and what they replace; replaced ones are left out, and age counts only for kinds of documents that grow old.",
         "Uses validity, not age alone.", "Treats kinds of documents differently.", "Admits the work of keeping dates."),
    item("answer-silence", "generation_and_grounding", "medium", "diagnostic", "No passage answers the question, and yet the assistant gives a fluent reply. How do you make it say that it does not know?",
         ["abstention", "evidence threshold", "answerability"], "Below a score that was set on questions without an answer nothing is written; the prompt allows a refusal, and a check compares the reply with the passages.",
         "Allows a refusal.", "Sets the threshold on unanswerable questions.", "Weighs false refusals against inventions."),
    item("answer-conflict", "generation_and_grounding", "hard", "design", "Two manuals disagree about a limit value. What should the answer say, and what must the passages carry for it?",
         ["source conflict", "provenance", "version"], "The answer names both values with their sources and says which is newer or binding, so passages need version, date and rank of their source.",
         "Shows the disagreement.", "Prefers the binding source and says why.", "Keeps the answer short all the same."),
    item("answer-tongue", "generation_and_grounding", "easy", "practical", "Questions come in Portuguese, and the documents are in English. At which point do you translate?",
         ["cross-lingual embedding", "query translation", "answer language"], "Vectors of both languages that share a space need no translation to search; the answer is written in the asker's tongue and quotes stay as they are.",
         "Separates search from writing.", "Leaves quotes untouched.", "Compares the cost of both ways."),
    item("measure-chance", "evaluation_and_benchmarks", "medium", "conceptual", "A change lifts the score from 71 to 74 on fifty questions. Is it better?",
         ["confidence interval", "paired comparison", "sample size"], "Fifty questions leave several points to chance; the same questions are compared pair by pair, and more are asked until the interval leaves zero out.",
         "Does not trust the difference.", "Compares pairs.", "Weighs more questions against labelling."),
    item("measure-made-up", "evaluation_and_benchmarks", "hard", "diagnostic", "Questions for the test were written by a model from the passages themselves. Why are the scores too good?",
         ["synthetic questions", "lexical overlap", "test set leakage"], "Such questions borrow the words of their passage, so any search finds it; questions are rewritten, taken from logs, or kept apart from what was used for training.",
         "Sees the borrowed words.", "Proposes real questions.", "Mentions what still speaks for made-up ones."),
    item("measure-clicks", "evaluation_and_benchmarks", "medium", "design", "Users' clicks are plenty and labels are few. How can clicks tell whether a ranking got better?",
         ["position bias", "interleaving", "click model"], "First places are clicked whatever they hold; results of both rankings are mixed for each user, and the side that gets more clicks wins.",
         "Knows that places draw clicks.", "Mixes both rankings.", "Weighs speed against risk for users."),
    item("steps-tables", "agentic_and_graph_rag", "medium", "design", "Some questions need a sum over the order table and some a passage of the handbook. How does the system choose, and what does it check?",
         ["tool selection", "text-to-sql", "query validation"], "A first step names the tool and its input; a query is run with read rights on a limited time, and its rows are shown with the answer.",
         "Chooses by the kind of question.", "Checks a query before running it.", "Limits rights and time."),
    item("steps-memory", "agentic_and_graph_rag", "hard", "conceptual", "What should an assistant keep of a talk for the next one, and what must it forget?",
         ["long-term memory", "summarization", "retention policy"], "Settled facts and wishes are kept as short notes with their date and can be shown and removed; guesses, secrets and what the user takes back are not.",
         "Separates facts from talk.", "Lets users see and remove notes.", "Weighs help against privacy."),
]
