"""The prompt templates of the engine's model-backed steps, to be filled with ``prompts.fill``."""

from __future__ import annotations

TEMPLATES: dict[str, str] = {
    # source, first_chunks, prev_chunk, chunk
    "chunk_context": """Write one or two sentences that say what the passage below is about, so that it can be found on its own.
Use only what is given, keep the language of the passage, and return the sentences alone.

File: {source}

Beginning of the file:
{first_chunks}

Text before the passage:
{prev_chunk}

Passage:
{chunk}
""",
    # no variables: the conversation follows as a message
    "query_context": """You turn a conversation into one search query.
Resolve what the last user message refers to in earlier messages; if it stands on its own, return it as it is.
Return the query alone, in the user's language.
""",
    # k_queries, query
    "multi_query": """Write {k_queries} different versions of the question below for a document search, each from another angle.
Put [SEP] between them and return nothing else.

Question: {query}
""",
    # question
    "hyde": """Write a short passage that could stand in a document and answers this question, without any introduction.
Question: {question}
""",
    # context
    "answer": """You answer questions from documents.
Rely on the context below only; say so if the answer isn't in it, and name the documents you used as [doc_n].

Context:
{context}
""",
    # no variables: the image follows as a message
    "image_caption": """Describe the image for a reader who can't see it: what kind of image it is, every text and figure in it, and what it shows.
Return the description alone.
""",
}
