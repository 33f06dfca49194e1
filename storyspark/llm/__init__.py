"""Training-data operators (PII, chat formatting, decontamination, language-model
scores, near-duplicates, licences, packing, HTML text, quality rules, token
counts). Nothing else in the library imports this subpackage."""
