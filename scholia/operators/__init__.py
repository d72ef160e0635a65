"""scholia.operators"""
