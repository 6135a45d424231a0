"""quernstone: activity, game and corpus analytics written as Spark jobs."""
