"""Registered queries."""


def all_registries() -> list:
    from corpusloom.plans import audio_queries, corpus_queries, source_queries, spike_queries, text_queries

    return [module.REGISTRY for module in (corpus_queries, text_queries, audio_queries, source_queries, spike_queries)]
