"""The jobs: exploration, summaries, staging and marts, table history, storage comparison."""
