"""Bundled grammars: text files read by ``stratigraph.llm.glr``."""
