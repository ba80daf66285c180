"""Entry script for spark-submit; see retentia/job.py."""

from retentia.job import main

if __name__ == "__main__":
    main()
