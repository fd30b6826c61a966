"""Queries of the corpus operators and their SQL, by name."""

from spanweave.llm import fingerprints, hmm, line_dedup, mih, minhash, mixing, pii, sentencepiece_bpe, suffix_dedup, toxicity

MODULES = [sentencepiece_bpe, toxicity, mih, mixing, line_dedup, pii, fingerprints, hmm, minhash, suffix_dedup]

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
