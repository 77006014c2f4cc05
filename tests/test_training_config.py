"""The registered training queries run the whole job."""

from adflow.plans.catalog import training


def test_queries_train_with_the_defaults(monkeypatch):
    seen = []
    monkeypatch.setattr(training, "labelled", lambda spark, d: None)
    monkeypatch.setattr(training.T, "run_training", lambda rows, config=training.T.TrainConfig(): seen.append(config))
    training._train(None, None)
    config = seen[0]
    assert (config.num_rounds, config.first_rounds, config.patience, config.max_depth) == (600, 40, 40, 6)
