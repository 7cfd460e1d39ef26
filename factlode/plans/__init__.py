"""factlode.plans"""
