"""Table analytics as Spark jobs: profiles, quality, insights, dictionary,
evaluation, drift and deep analyses, all DataFrame in and DataFrame out."""
